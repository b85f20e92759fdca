"""Screens on a prepared table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from assaylane.operators.screens import apply_screens


def screen(
    df: DataFrame,
    screens: Sequence[str] | str = "all",
    pains: Callable[[DataFrame], DataFrame] | None = None,
    chelators: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the chosen screen columns; a column from an earlier run is replaced."""
    return apply_screens(df, screens, pains, chelators)
