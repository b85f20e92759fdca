"""Sets of 64-bit numbers as bitmaps of a fixed size, for tasks to leave out what cannot matter.

A number that is in the set is always found; one that is not may be found by chance, and more often the fuller the
bitmap is. So a bitmap may save work but decides nothing. Its size is bounded whatever the set: ``BITS`` / 8 bytes go
to the driver and to the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bitmap_of(df: DataFrame, number: str | Column, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of longs, put together from words of 64 bits."""
    number = F.col(number) if isinstance(number, str) else number
    slot = number.bitwiseAND(F.lit(bits - 1)).alias("slot")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = df.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    table = words.toArrow()  # at most ``bits`` / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers (uint64) may be in the set."""
    slot = numbers & np.uint64(64 * len(bitmap) - 1)
    return ((bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def may_hold(bitmap: np.ndarray):
    """``in_bitmap`` as a function of a column of longs; no other column goes to Python."""

    @F.pandas_udf("boolean")
    def held(numbers: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap, numbers.to_numpy(np.int64).view(np.uint64)))

    return held
