"""Seeded stratified splits, folds and samples.

Rows of a class are ordered by the seeded hash of their id, rows with one id by their index, and a split is a range
of that order. Only the keys at the range ends are looked up, for all classes together; adding the column is then a
join with one row per class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.fixed import ROW_INDEX, SEED
from assaylane.functions.seeds import seed_hash
from assaylane.operators.columns import col
from assaylane.operators.labels import ClassSizes, class_sizes
from assaylane.operators.ordering import ordered_index
from assaylane.operators.selection import ABOVE_ALL, BELOW_ALL, order_key, rank_cuts
from assaylane.session import materialize
from assaylane.sources.rows import with_row_index

SPLITS = ("train", "val", "test")
_MADE = "_made_row_index"


def allocated(classes: DataFrame, rows: str, size: int, n: int, out: str) -> DataFrame:
    """Share ``size`` of ``n`` rows over classes of ``rows`` rows in proportion, leftovers to the largest remainders.

    ``classes`` has one row per class ``g``; only these rows are ordered in one task.
    """
    share = F.lit(float(size)) * F.col(rows) / F.lit(n) if n else F.lit(0.0)
    shares = classes.withColumn("share", share).withColumn("given", F.floor("share").cast("long"))
    by_remainder = Window.partitionBy(F.lit(0)).orderBy((F.col("share") - F.col("given")).desc(), F.col("g"))
    whole = by_remainder.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = shares.select("*", F.row_number().over(by_remainder).alias("nth"), F.sum("given").over(whole).alias("placed"))
    extra = (F.col("nth") <= F.lit(size) - F.col("placed")).cast("long")
    return ranked.select(*classes.columns, (F.col("given") + extra).alias(out))


def split_sizes(sizes: ClassSizes, train: float, val: float) -> DataFrame:
    """Rows per class and split (``n_train``, ``n_val``): train first, then the rest by ``val / (val + test)``."""
    if not 0 < train < 1:
        raise ValueError("train must be in (0, 1)")
    if not 0 <= val < 1:
        raise ValueError("val must be in [0, 1)")
    if not train + val < 1:
        raise ValueError("train + val must be below 1")
    n, test = sizes.rows, 1.0 - train - val
    n_train = floor(train * n)
    n_val = floor(val / (val + test) * (n - n_train))
    in_train = allocated(sizes.table, "k", n_train, n, "n_train")
    rest = in_train.withColumn("rest", F.col("k") - F.col("n_train"))
    return allocated(rest, "rest", n_val, n - n_train, "n_val").drop("rest")


def stratified_split(
    df: DataFrame,
    y: str,
    id_col: str,
    train: float = 0.75,
    val: float = 0.15,
    seed: int = SEED,
    out: str = "split",
    ties: str | None = None,
) -> DataFrame:
    """Add ``split`` (train, val or test) with exact class shares, for any number of classes.

    ``ties`` tells rows with one id apart: ``row_idx`` where the table has it, else an index made when needed.
    """
    classes = class_sizes(df, y)
    sizes = split_sizes(classes, train, val)
    ends = [F.col("n_train"), F.col("n_train") + F.col("n_val")]
    return _assign(df, y, id_col, sizes, classes.largest, ends, list(SPLITS), seed, out, ties)


def stratified_folds(
    df: DataFrame, y: str, id_col: str, k: int = 5, seed: int = SEED, out: str = "fold", ties: str | None = None
) -> DataFrame:
    """Add ``fold`` 0..k-1; the folds of a class differ by one row at most."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    ends = [F.floor(F.col("k") * j / k).cast("long") for j in range(1, k)]
    classes = class_sizes(df, y)
    return _assign(df, y, id_col, classes.table, classes.largest, ends, list(range(k)), seed, out, ties)


def _assign(
    df: DataFrame, y: str, id_col: str, sizes: DataFrame, largest: int, ends: Sequence[Column], names: list, seed: int,
    out: str, ties: str | None,
) -> DataFrame:
    """``names[i]`` for the rows of a class whose rank lies after end ``i-1`` and up to end ``i``."""
    ties = ties or (ROW_INDEX if ROW_INDEX in df.columns else None)
    key = order_key(id_col, ties, seed)
    kind = "string" if isinstance(names[0], str) else "int"
    ranks = F.array(*[F.struct(F.lit(i).alias("slot"), e.alias("rank")) for i, e in enumerate(ends)])
    wanted = materialize(sizes.select("g", "k", F.explode(ranks).alias("w")).select("g", "k", "w.slot", "w.rank"))
    inner = wanted.where("rank > 0 AND rank < k").select("g", "slot", "rank")
    found = rank_cuts(df.select(col(y).alias("g"), key.alias("key")), inner, largest)
    if not found.where("tied").isEmpty():  # the cut falls between rows with one id
        indexed = with_row_index(df, _MADE)
        return _assign(indexed, y, id_col, sizes, largest, ends, names, seed, out, _MADE).drop(_MADE)
    edge = F.when(F.col("rank") <= 0, BELOW_ALL).when(F.col("rank") >= F.col("k"), ABOVE_ALL).otherwise(F.col("cut"))
    cuts = (
        wanted.join(found, ["g", "slot"], "left")
        .groupBy(F.col("g").alias("_class"))
        .agg(*[F.max(F.when(F.col("slot") == i, edge)).alias(f"_cut{i}") for i in range(len(ends))])
    )
    chosen = F.lit(names[-1])
    for i in reversed(range(len(ends))):
        chosen = F.when(F.col("_key") <= F.col(f"_cut{i}"), F.lit(names[i])).otherwise(chosen)
    placed = df.drop(out).withColumn("_key", key).join(cuts, col(y) == F.col("_class"))
    return placed.withColumn(out, chosen.cast(kind)).select(*[col(c) for c in df.columns if c != out], out)


def sample_n(df: DataFrame, id_col: str, n: int = 500, seed: int = SEED) -> DataFrame:
    """``min(n, rows)`` rows without replacement: the lowest hashes, a top-k without a full sort."""
    hashed = df.withColumn("_hash", seed_hash(col(id_col), seed=seed))
    return hashed.orderBy("_hash").limit(n).drop("_hash")


def split_ids(df: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """Long form of the split lists: ``id, split``."""
    return df.select(col(id_col).cast("string").alias("id"), col(split).alias("split"))


def split_table_wide(df: DataFrame, id_col: str, order_by: str, split: str = "split") -> DataFrame:
    """Ids of the three splits side by side, each in ``order_by`` order, padded with nulls. One pass over ``df``."""
    place = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), col(split)) - 1
    stacked = df.select(place.cast("int").alias("_list"), col(order_by).alias("_order"), col(id_col).cast("string").alias("_value"))
    return _side_by_side(stacked.where("_list >= 0"), [f"{s}_ids" for s in SPLITS])


def zip_columns(frames: list[DataFrame], order_by: str) -> DataFrame:
    """Put one-column frames side by side by position; ``order_by`` gives each frame's row order.

    The shorter ones are padded with nulls. Positions are numbered range by range, then matched.
    """
    names = [next(c for c in f.columns if c != order_by) for f in frames]
    parts = [
        frame.select(F.lit(i).alias("_list"), col(order_by).alias("_order"), col(names[i]).cast("string").alias("_value"))
        for i, frame in enumerate(frames)
    ]
    return _side_by_side(reduce(DataFrame.unionByName, parts), names)


def _side_by_side(stacked: DataFrame, names: list[str]) -> DataFrame:
    """The values of list 0, 1, ... as columns. One numbering covers all lists; a list starts at its lowest number."""
    numbered = ordered_index(stacked, [F.col("_list"), F.col("_order")], "_rn", start=0)
    starts = {r["_list"]: r["s"] for r in numbered.groupBy("_list").agg(F.min("_rn").alias("s")).collect()}
    start = F.lit(0)
    for i, s in starts.items():
        start = F.when(F.col("_list") == i, F.lit(s)).otherwise(start)
    placed = numbered.withColumn("_pos", F.col("_rn") - start)
    wide = placed.groupBy("_pos").agg(
        *[F.first(F.when(F.col("_list") == i, F.col("_value")), ignorenulls=True).alias(n) for i, n in enumerate(names)]
    )
    return wide.select(*[col(n) for n in names])
