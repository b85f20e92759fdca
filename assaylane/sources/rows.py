"""Row identity: a stable index for data that comes without one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylane.operators.columns import col
from assaylane.session import materialize

_PATH, _BLOCK, _NTH = "_row_path", "_row_block", "_row_nth"
BROADCAST_SPLITS = 1_000_000  # splits whose offsets are sent to all tasks: 24 bytes each


def with_row_index(df: DataFrame, out: str = "row_idx", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` as they lie in their files, and store them with that number.

    Files go by path, the rows of a file by their place in it: the start of the split and the position
    there. So the number does not change with the cluster, nor with the order in which splits are read.
    Data that does not come straight from files is written first and numbered as written. No sort and no
    shuffle of rows: only one row per split is ordered.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out!r} already")
    try:
        return index_placed(placed(df), out, start)
    except (AnalysisException, _Scattered):  # no file metadata, or rows of a split were moved apart
        return index_placed(placed(materialize(df)), out, start)


def index_placed(df: DataFrame, out: str, start: int = 0) -> DataFrame:
    """The table of ``placed``, stored, with row numbers instead of the places."""
    stored = materialize(df)
    splits = _splits(stored)
    if not splits.where("last - first + 1 > n").isEmpty():
        raise _Scattered
    before = Window.orderBy(_PATH, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("key", "block", "first", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.lit(start)).alias("offset"))
    if splits.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = stored.join(offsets, (F.xxhash64(_PATH) == F.col("key")) & (F.col(_BLOCK) == F.col("block")))
    number = (F.col("offset") + F.col(_NTH) - F.col("first")).cast("long")
    return joined.select(*[col(c) for c in df.columns if c not in (_PATH, _BLOCK, _NTH)], number.alias(out))


class _Scattered(Exception):
    pass


def placed(df: DataFrame) -> DataFrame:
    """The rows of files, each with the path, the start of the split and its place there."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(_PATH),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_NTH),
    )


def _splits(placed: DataFrame) -> DataFrame:
    """One row per split, written, as several passes read it."""
    return materialize(
        placed.groupBy(_PATH, _BLOCK)
        .agg(F.count("*").alias("n"), F.min(_NTH).alias("first"), F.max(_NTH).alias("last"))
        .select("*", F.xxhash64(_PATH).alias("key"), F.col(_BLOCK).alias("block"))
    )
