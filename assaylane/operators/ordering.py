"""Order over a whole table without a single sorting task.

A window without partitions sends every row to one task. The helpers here spread the order over
many tasks: ranges of the order key, each numbered or summed on its own, plus the totals of all
ranges before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.operators.columns import col, quoted
from assaylane.session import materialize

ROWS_PER_TASK = 1_000_000
SAMPLE_ROWS = 1_000_000


def ordered_index(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given order.

    The range-sorted rows are written once: range bounds come from a sample, so they must not be
    drawn again between counting the ranges and numbering the rows. ``order`` should tell all rows
    apart; a hot value is then split between ranges by the later order columns. The number of ranges
    follows from the number of rows. Give narrow rows: whatever is in ``df`` moves.
    """
    part, pos, offset = "_range", "_pos", "_offset"
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = max(1, ceil(df.count() / ROWS_PER_TASK))
    ranged = (
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias(part), in_range.alias(pos))
    )
    stored = materialize(ranged)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, so one for each million rows
    offsets = stored.groupBy(part).agg(F.count("*").alias("_n")).select(
        part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(offset)
    )
    return (
        stored.join(F.broadcast(offsets), part)
        .withColumn(name, F.col(offset) + F.col(pos) + F.lit(start))
        .drop(part, pos, offset)
    )


def range_bounds(df: DataFrame, value: Column, rows_per_task: int | None = None) -> list[float]:
    """Inner bounds that cut ``value`` into ranges of about ``rows_per_task`` rows.

    Drawn from a sample. They only balance the tasks; no result depends on them.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    frame = df.select(value.cast("double").alias("v"))
    n = frame.count()
    ranges = ceil(n / rows_per_task)
    if ranges <= 1:
        return []
    share = min(1.0, max(SAMPLE_ROWS, 100 * ranges) / n)
    steps = [i / ranges for i in range(1, ranges)]
    bounds = frame.sample(share, seed=1).agg(F.percentile_approx("v", steps, 10 * ranges)).first()[0]
    return sorted({b for b in bounds or [] if b == b})


def running_totals(
    df: DataFrame,
    value: str,
    amounts: Mapping[str, Column],
    keys: Sequence[str] = (),
    descending: bool = True,
    rows_per_task: int | None = None,
    range_name: str | None = None,
) -> DataFrame:
    """Per distinct ``value``: the sums of ``amounts``, and their running sums ``cum_<name>``.

    Rows with equal values are added up before the sort, so a hot value is one row by then. Large
    inputs are cut into value ranges; a running sum is the one inside the range plus the totals of
    the ranges before it. ``keys`` gives one running sum per group. Null values are left out. The
    number of the value range stays as ``range_name`` if given.
    """
    frame = df.select(
        *[col(k) for k in keys],
        col(value).cast("double").alias(value),
        *[a.alias(name) for name, a in amounts.items()],
    ).where(col(value).isNotNull())
    bounds = range_bounds(frame, col(value), rows_per_task)
    rng = "_range"
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        bucketizer = Bucketizer(splits=splits, inputCol=value, outputCol=rng, handleInvalid="keep")
        frame = bucketizer.transform(frame).withColumn(rng, F.col(rng).cast("int"))
    else:
        frame = frame.withColumn(rng, F.lit(0))

    group = [col(k) for k in keys]
    sums = [F.sum(name).alias(name) for name in amounts]
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    inside = Window.partitionBy(*group, rng).orderBy(direction(col(value)))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_value = frame.groupBy(*group, rng, col(value)).agg(*sums)
    per_value = per_value.select("*", *[F.sum(n).over(inside).alias(f"cum_{n}") for n in amounts])
    kept = [F.col(rng).alias(range_name)] if range_name else []
    if not bounds:
        return per_value.select(*[c for c in per_value.columns if c != rng], *kept)

    before = Window.partitionBy(*group).orderBy(direction(F.col(rng)))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frame.groupBy(*group, rng)
        .agg(*sums)
        .select(
            *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col(rng).alias("_r"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in amounts],
        )
    )
    # joined on the columns the running sums are already partitioned by, so only the small side moves
    same = F.col(rng) == F.col("_r")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = per_value.join(offsets, same)
    return joined.select(
        *group,
        col(value),
        *[F.col(n) for n in amounts],
        *[(F.col(f"cum_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in amounts],
        *kept,
    )


@dataclass
class Found:
    """An order statistic: the value, the rows below it and the rows that have it."""

    value: float
    below: int
    equal: int


@dataclass
class _Bracket:
    """Where one wanted rank of one column can lie: codes ``lo..hi``, ``below`` rows under them, ``inside`` in them."""

    column: int
    rank: int
    lo: int
    hi: int
    below: int
    inside: int
    found: Found | None = None

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.column, self.lo, self.hi


_BINS = 4096
FINAL_ROWS = 10_000  # values of a bracket that the driver may see


def _codes(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the numbers, infinities included."""
    bits = (values + 0.0).view(np.int64)  # -0.0 is 0.0
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _number(code: int) -> float:
    bits = code ^ 0x7FFFFFFFFFFFFFFF if code < 0 else code
    return float(np.array([bits], np.int64).view(np.float64)[0])


def _column_codes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    column = batch.column(i)
    values = column.drop_null().to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)
    return _codes(values[~np.isnan(values)])


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks_of: Callable[[int], list[int]], final_rows: int | None = None
) -> tuple[dict[str, int], dict[str, list[Found]]]:
    """Exact order statistics of many columns at once; null and NaN are no values.

    ``ranks_of(n)`` gives the wanted 1-based ranks for a column with ``n`` values. Numbers are taken as integer codes
    in the same order. A pass counts, for all columns together, a histogram of equal bins over each bracket of codes
    that holds a wanted rank; the histograms of the tasks are added up bin by bin, and each bracket shrinks to one of
    its bins. Six passes end any distribution; a bracket of ``final_rows`` values is read instead. The table keeps its
    width: rows are never turned into cells.
    """
    final = final_rows if final_rows is not None else FINAL_ROWS
    wide = df.select([F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    profile = {r["c"]: r for r in _profile(wide, len(columns))}  # one row per column
    counts = {c: profile[i]["n"] if i in profile else 0 for i, c in enumerate(columns)}
    brackets = [
        _Bracket(i, rank, profile[i]["lo"], profile[i]["hi"], 0, profile[i]["n"])
        for i in profile
        for rank in ranks_of(profile[i]["n"])
    ]
    while open_ := [b for b in brackets if b.inside > final and b.lo < b.hi]:
        _narrow(wide, open_)
    _finish(wide, [b for b in brackets if b.lo < b.hi])
    out: dict[str, list[Found]] = {c: [] for c in columns}
    for b in brackets:
        out[columns[b.column]].append(b.found or Found(_number(b.lo), b.below, b.inside))
    return counts, out


def values_at_ranks(
    df: DataFrame, columns: Sequence[str], ranks_of: Callable[[int], list[int]], final_rows: int | None = None
) -> tuple[dict[str, int], dict[str, list[float]]]:
    """As ``order_statistics``, the values alone."""
    counts, found = order_statistics(df, columns, ranks_of, final_rows)
    return counts, {c: [f.value for f in fs] for c, fs in found.items()}


def _profile(wide: DataFrame, n: int) -> list:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, np.int64)
        lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for batch in batches:
            for i in range(n):
                codes = _column_codes(batch, i)
                if len(codes):
                    seen[i] += len(codes)
                    lo[i], hi[i] = min(lo[i], codes.min()), max(hi[i], codes.max())
        has = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(seen[has]), pa.array(lo[has]), pa.array(hi[has])], names=["c", "n", "lo", "hi"])

    parts = wide.mapInArrow(profile, "c int, n long, lo long, hi long")
    return parts.groupBy("c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def _width(lo: int, hi: int) -> int:
    return (hi - lo) // _BINS + 1


def _narrow(wide: DataFrame, brackets: list[_Bracket]) -> None:
    """One pass: a histogram of every bracket, of which the bin that holds the rank is kept."""
    shapes = sorted({b.shape for b in brackets})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shapes), _BINS), np.int64)
        for batch in batches:
            codes: dict[int, np.ndarray] = {}
            for s, (c, lo, hi) in enumerate(shapes):
                if c not in codes:
                    codes[c] = _column_codes(batch, c)
                own = codes[c][(codes[c] >= lo) & (codes[c] <= hi)]
                # the difference may pass 63 bits, so it is taken without a sign
                away = own.view(np.uint64) - np.array(lo, np.int64).view(np.uint64)
                total[s] += np.bincount((away // np.uint64(_width(lo, hi))).astype(np.int64), minlength=_BINS)
        s, b = np.nonzero(total)
        yield pa.record_batch([pa.array(s, pa.int32()), pa.array(b, pa.int32()), pa.array(total[s, b])], names=["s", "b", "n"])

    counted = wide.mapInArrow(count, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n"))
    bins: dict[int, list[tuple[int, int]]] = {}
    for row in counted.collect():  # at most _BINS rows per bracket
        bins.setdefault(row["s"], []).append((row["b"], row["n"]))
    for b in brackets:
        width, low = _width(b.lo, b.hi), b.lo
        for place, n in sorted(bins[shapes.index(b.shape)]):
            if b.below + n >= b.rank:
                b.lo, b.hi, b.inside = low + place * width, min(low + (place + 1) * width - 1, b.hi), n
                break
            b.below += n


def _finish(wide: DataFrame, brackets: list[_Bracket]) -> None:
    """Read the wanted ranks off the values left inside the brackets, at most ``final_rows`` for each."""
    if not brackets:
        return
    shapes = sorted({b.shape for b in brackets})

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for s, (c, lo, hi) in enumerate(shapes):
                codes = _column_codes(batch, c)
                codes = codes[(codes >= lo) & (codes <= hi)]
                which.append(np.full(len(codes), s, np.int32))
                held.append(codes)
            yield pa.record_batch([pa.array(np.concatenate(which)), pa.array(np.concatenate(held))], names=["s", "code"])

    table = wide.mapInArrow(left, "s int, code long").toArrow()
    which, codes = table.column("s").to_numpy(), table.column("code").to_numpy()
    for s, shape in enumerate(shapes):
        own = np.sort(codes[which == s])
        for b in (b for b in brackets if b.shape == shape):
            code = own[b.rank - b.below - 1]
            first, last = np.searchsorted(own, code, "left"), np.searchsorted(own, code, "right")
            b.found = Found(_number(int(code)), b.below + int(first), int(last - first))
