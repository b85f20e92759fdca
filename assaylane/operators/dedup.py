"""Keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylane.operators.columns import col


def dedup_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row per key in a given order; null keys are equal to each other.

    ``row_number() = 1`` makes Spark drop all but one row per key inside each task before the
    shuffle (a window group limit), so a key that holds a third of all rows stays cheap.
    ``order_by`` should tell all rows apart, or the kept row is any of the first ones.
    """
    order = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in order_by])
    return df.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows ``dedup_first`` removes: one row ``rows_before, rows_after, removed``."""
    groups = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n"))
    before, after = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return groups.agg(
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("removed")
    )
