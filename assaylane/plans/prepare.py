"""From a raw export to a clean descriptor table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from assaylane import fixed
from assaylane.operators.assay import filter_assay
from assaylane.operators.columns import (
    conform,
    drop_all_null,
    drop_incomplete,
    non_null_columns,
)
from assaylane.operators.dedup import dedup_first
from assaylane.operators.enrich import with_descriptors
from assaylane.session import materialize


def prepare(
    df: DataFrame,
    text_col: str,
    make_featurizer: Callable,
    columns: Sequence[str] = tuple(fixed.DESCRIPTOR_COLUMNS),
    order_by: Sequence[str] = ("row_idx",),
    required: Sequence[str] = tuple(fixed.CORE_COLUMNS + fixed.CHI_COLUMNS + fixed.VSA_COLUMNS),
    meta: Sequence[str] = tuple(fixed.META_COLUMNS),
    key: str = "canonical_smiles",
    partitions: int | None = None,
    row_filter: Callable[[DataFrame], DataFrame] = filter_assay,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Filter, describe, keep the first row per key, and drop incomplete rows and empty columns.

    Equal texts are dropped before the costly descriptor step: equal text means equal key, and the
    first row of a key is also the first of its text. The described rows are written once, as the
    column profiles and the result read them several times. ``keep`` adds columns to the kept ones.
    """
    rows = dedup_first(row_filter(df), [text_col], order_by)
    described = with_descriptors(rows, text_col, make_featurizer, columns, key, partitions)
    first = dedup_first(described, [key], order_by)
    table = materialize(conform(first, [*meta, *keep], columns, key))
    supported = non_null_columns(table, columns)
    complete = drop_incomplete(table, [c for c in required if c in supported])
    if not supported:  # nothing described, or no rows at all: keep the typed columns
        return complete
    return drop_all_null(complete, columns)
