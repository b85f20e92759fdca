"""Median imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from assaylane.operators.columns import quoted
from assaylane.operators.ordering import values_at_ranks


def fit_median(df: DataFrame, cols: Sequence[str], **limits: int) -> dict[str, float]:
    """Exact median per column (mean of the two middle values); columns without a value are left out.

    Not ``percentile``/``median``, which keep every distinct value of a column in one task's memory.
    """
    middle = lambda n: sorted({(n + 1) // 2, n // 2 + 1})
    _, values = values_at_ranks(df, cols, middle, **limits)
    return {c: sum(v) / len(v) for c, v in values.items() if v}


def filled(source: str, median: float) -> str:
    """SQL for a number with its gaps (null or NaN) filled."""
    return f"coalesce(nanvl(CAST({source} AS DOUBLE), NULL), CAST('{float(median)!r}' AS DOUBLE))"


def apply_median(df: DataFrame, medians: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Fill gaps with the fitted medians; only ``keep`` and the fitted columns stay."""
    numbers = [f"{filled(quoted(c), m)} AS {quoted(c)}" for c, m in medians.items()]
    return df.selectExpr(*[quoted(c) for c in keep], *numbers)
