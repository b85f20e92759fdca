"""Class labels: the most potent fraction, class counts and weights."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.fixed import ROW_INDEX, SEED
from assaylane.operators.columns import col, number
from assaylane.operators.ordering import order_statistics
from assaylane.operators.selection import order_key, rank_cuts
from assaylane.session import materialize
from assaylane.sources.rows import with_row_index

_MADE = "_made_row_index"


def label_by_fraction(
    df: DataFrame,
    value: str,
    id_col: str,
    fraction: float = 0.5,
    seed: int = SEED,
    out: str = "activo",
    ties: str | None = None,
    **limits: int,
) -> DataFrame:
    """Label the ``fraction`` of rows with the lowest values 1, all others 0.

    Exactly ``clamp(floor(fraction * n), 1, n)`` of the ``n`` rows with a value get 1. Among rows
    tied at the cut, the seeded hash of ``id_col`` decides, and between rows with one id the row
    index ``ties`` (``row_idx`` where the table has it, else one is made when needed). Labelling
    itself is a projection without a shuffle.
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    ties = ties or (ROW_INDEX if ROW_INDEX in df.columns else None)
    number_ = number(df, value)
    frame = materialize(df.select(number_.alias("v"), order_key(id_col, ties, seed).alias("key")))
    wanted = lambda n: [max(1, min(floor(fraction * n), n))]
    counts, found = order_statistics(frame, ["v"], wanted, **limits)
    if not found["v"]:
        return df.withColumn(out, F.lit(0))
    at = found["v"][0]
    left = wanted(counts["v"])[0] - at.below
    active = number_ <= at.value
    if left < at.equal:
        group = F.lit(0).alias("g")
        ranks = frame.sparkSession.range(1).select(group, F.lit(0).alias("slot"), F.lit(left).alias("rank"))
        cut = rank_cuts(frame.where(F.col("v") == at.value).select(group, "key"), ranks, at.equal).first()
        if cut["tied"]:
            indexed = with_row_index(df, _MADE)
            return label_by_fraction(indexed, value, id_col, fraction, seed, out, _MADE, **limits).drop(_MADE)
        chosen = order_key(id_col, ties, seed) <= cut["cut"]
        active = (number_ < at.value) | ((number_ == at.value) & chosen)
    return df.withColumn(out, F.coalesce(active, F.lit(False)).cast("int"))


def label_cutoff(df: DataFrame, value: str, y: str = "activo") -> DataFrame:
    """Largest value among the rows labelled 1."""
    return df.agg(F.max(F.when(col(y) == 1, number(df, value))).alias("cutoff"))


def class_distribution(df: DataFrame, y: str = "activo") -> DataFrame:
    return df.groupBy(col(y)).agg(F.count("*").alias("n")).orderBy(col(y))


@dataclass
class ClassSizes:
    """``g, k``: rows per class, written once, for any number of classes; and what all classes have together."""

    table: DataFrame
    rows: int
    classes: int
    largest: int


def class_sizes(df: DataFrame, y: str) -> ClassSizes:
    """Rows per class. A missing label is an error."""
    counted = materialize(df.groupBy(col(y).alias("g")).agg(F.count("*").alias("k")))
    facts = counted.agg(F.sum("k").alias("n"), F.count("*").alias("c"), F.max("k").alias("m"), F.count_if(F.col("g").isNull()).alias("missing")).first()
    if facts["missing"]:
        raise ValueError(f"{y} has missing labels")
    return ClassSizes(counted, facts["n"] or 0, facts["c"], facts["m"] or 0)


def with_class_weight(df: DataFrame, y: str = "activo", out: str = "weight") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per row, joined by class."""
    sizes = class_sizes(df, y)
    if not sizes.rows:
        return df.withColumn(out, F.lit(None).cast("double"))
    weight = F.lit(float(sizes.rows)) / (F.lit(sizes.classes) * F.col("k"))
    weights = sizes.table.select(F.col("g").alias("_class"), weight.alias(out))
    return df.drop(out).join(weights, col(y) == F.col("_class")).drop("_class")
