"""Exact ranks among the keys of many groups, by radix selection.

Rows of a group are in the order of a text key: the seeded hash of their id, then the index of the row, so that rows
which share an id are told apart. A pass counts rows per (group, key prefix) and keeps, for every wanted rank, the one
prefix that holds it; the next pass looks only at rows below those prefixes and goes some digits further. Prefix tables
are refined by joins and stay in the cluster, whatever the number of groups. When few rows share a prefix, they are
numbered in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.functions.seeds import seed_hash
from assaylane.operators.columns import col
from assaylane.session import materialize

DIGITS = 4  # of a pass: up to 65,536 prefixes for each prefix before
HASH_DIGITS = 32
ROWS_PER_PREFIX = 100_000  # rows that are numbered in one window

BELOW_ALL, ABOVE_ALL = "", "~"  # cuts before the first and behind the last key


def order_key(id_col: str, ties: str | None, seed: int) -> Column:
    """Seeded hash of the id, then the row index, as hexadecimal text of one length."""
    key = seed_hash(col(id_col), seed=seed)
    if ties is None:
        return key
    return F.concat(key, F.lpad(F.hex(col(ties).cast("long")), 16, "0"))


def rank_cuts(
    keys: DataFrame, wanted: DataFrame, largest: int, rows_per_prefix: int | None = None
) -> DataFrame:
    """``g, slot, cut, tied``: the key at each wanted 1-based rank within its group.

    ``keys`` has ``g`` and ``key``; ``wanted`` has ``g``, ``slot`` and ``rank``, ranks within the group's size; no
    group has more than ``largest`` rows. ``key <= cut`` holds for exactly ``rank`` rows unless ``tied``: then the
    next row has the same key.
    """
    few = rows_per_prefix or ROWS_PER_PREFIX
    keys = keys.select("g", "key")
    state = wanted.select("g", "slot", F.col("rank").cast("long").alias("left"), F.lit("").alias("prefix"))
    length, inside = 0, largest
    while inside > few and length < HASH_DIGITS + 16:
        # many rows with one hash are one id: go on with the row index at once
        step = DIGITS if length != 2 * DIGITS else HASH_DIGITS - length
        longer = F.substring("key", 1, length + step).alias("longer")
        counts = _below(keys, state, length).groupBy("g", "prefix", longer).agg(F.count("*").alias("n"))
        order = Window.partitionBy("g", "prefix").orderBy("longer")
        upto = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        state = materialize(
            state.select("g", "slot", "left", "prefix").join(upto, ["g", "prefix"])
            .where((F.col("left") > F.col("upto") - F.col("n")) & (F.col("left") <= F.col("upto")))
            .select("g", "slot", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("longer").alias("prefix"), F.col("n").alias("inside"))
        )
        length += step
        inside = state.agg(F.max("inside")).first()[0] or 0
    order = Window.partitionBy("g", "prefix").orderBy("key")
    numbered = _below(keys, state, length).select(
        "g", "prefix", "key", F.row_number().over(order).cast("long").alias("left"), F.lead("key").over(order).alias("next")
    )
    return materialize(
        state.join(numbered, ["g", "prefix", "left"]).select("g", "slot", F.col("key").alias("cut"), F.col("next").eqNullSafe(F.col("key")).alias("tied"))
    )


def _below(keys: DataFrame, state: DataFrame, length: int) -> DataFrame:
    """The rows below the prefixes that are still looked at."""
    cut = keys.withColumn("prefix", F.substring("key", 1, length) if length else F.lit(""))
    return cut.join(state.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
