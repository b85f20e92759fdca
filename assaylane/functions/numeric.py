from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylane.fixed import ACTIVE, INACTIVE
from assaylane.functions.text import safe_float


def numeric(col: Column) -> Column:
    """Like ``safe_float`` with NaN as null: one kind of missing value."""
    return F.nanvl(safe_float(col), F.lit(None).cast("double"))


def first_available(*cols: Column) -> Column:
    """First source that yields a value; NaN counts as no value."""
    return F.coalesce(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in cols])


def classify(prob: Column, threshold: float = 0.5) -> Column:
    return (prob >= F.lit(float(threshold))).cast("int")


def round3(col: Column) -> Column:
    """Three places, halves to even, decided on the scaled double (so 1.0015 gives 1.001)."""
    return F.rint(col * 1000) / 1000


def class_text(pred: Column) -> Column:
    return F.when(pred == 1, ACTIVE).otherwise(INACTIVE)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
