"""A distributed LSD radix sort: stable counting sort passes over the digits of a composite key.

Rows lie in tiles of bounded size; a row's place is its tile and its position. A pass counts the rows of
each (tile, digit), adds the counts up, digits first and tiles second, and so knows where the first row of
each (tile, digit) goes in the whole order. Within a tile a stable sort by the digit gives the places of the
others. Each row moves once in a pass, to the tile of its place; as tiles are cut by position, equal keys
never make one larger. After the last digit the place of a row is its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylane.session import materialize

DIGIT_BITS = 11
LEAST_TILE, MOST_TILE, TILES = 4_096, 1 << 20, 2_000


def tile_rows(rows: int) -> int:
    """Rows of a tile: about ``TILES`` tiles, within bounds that suit a task."""
    return min(max(-(-rows // TILES), LEAST_TILE), MOST_TILE)


def digits_of(widths: Sequence[int], most: int = DIGIT_BITS) -> list[tuple[int, int, int]]:
    """(key, shift, bits) of the digits of a composite key of ``widths`` bits, least significant first."""
    out = []
    for key in range(len(widths) - 1, -1, -1):
        n = -(-widths[key] // most)
        cuts = [widths[key] * i // n for i in range(n + 1)] if n else [0]
        out += [(key, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def _place(column: str, shift: int, bits: int, tile: int):
    """New places of the rows of a tile."""

    def place(rows: pa.Table, counts: pa.Table) -> pa.Table:
        offset = np.zeros(1 << bits, np.int64)
        offset[counts.column("digit").to_numpy()] = counts.column("offset").to_numpy()
        rows = rows.take(pa.array(np.argsort(rows.column("at").to_numpy(), kind="stable")))
        digit = ((rows.column(column).to_numpy() >> shift) & ((1 << bits) - 1)).astype(np.uint16)
        order = np.argsort(digit, kind="stable")
        digit = digit[order].astype(np.int64)
        size = np.bincount(digit, minlength=1 << bits)
        nth = np.arange(len(digit)) - (np.cumsum(size) - size)[digit]
        at = offset[digit] + nth
        rows = rows.take(pa.array(order))
        rows = rows.set_column(rows.schema.get_field_index("at"), "at", pa.array(at))
        return rows.set_column(rows.schema.get_field_index("tile"), "tile", pa.array(at // tile))

    return place


def radix_sorted(df: DataFrame, widths: Sequence[int], keys: Sequence[str], name: str, digit_bits: int = DIGIT_BITS, tile: int | None = None) -> DataFrame:
    """``df`` with the position 0, 1, ... of every row in ascending order of the composite key, most significant
    column first. ``keys`` are columns of non-negative longs below 2^width. Rows with equal keys keep the order in
    which they were first written.

    The driver sees row counts per digit only, at most 2^digit_bits numbers a pass.
    """
    local = F.monotonically_increasing_id()
    placed = materialize(df.select("*", F.spark_partition_id().cast("long").alias("tile"), local.alias("at")))
    tile = tile or tile_rows(placed.count())
    for key, shift, bits in digits_of(widths, digit_bits):
        digit = F.shiftright(F.col(keys[key]), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("digit")
        counts = materialize(placed.select("tile", digit).groupBy("tile", "digit").agg(F.count("*").alias("n")))
        totals = sorted(counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
        if not totals:
            break
        ends = np.cumsum([n for _, n in totals]).tolist()
        base = df.sparkSession.createDataFrame([(d, e - n) for (d, n), e in zip(totals, ends, strict=True)], "digit int, base long")
        before = Window.partitionBy("digit").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(base), "digit")
        offsets = offsets.select("tile", "digit", (F.col("base") + F.col("upto")).alias("offset"))
        moved = placed.groupBy("tile").cogroup(offsets.groupBy("tile")).applyInArrow(_place(keys[key], shift, bits, tile), placed.schema)
        placed = materialize(moved)
    return placed.withColumn(name, F.col("at")).drop("tile", "at")
