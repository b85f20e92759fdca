"""Row enrichment with numeric descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane.batches import pieces
from assaylane.operators.columns import col

# What a featuriser returns for one valid text: its canonical key and named numbers.
Features = tuple[str | None, Mapping[str, float]]


def with_descriptors(
    df: DataFrame,
    text_col: str,
    make_featurizer: Callable[[], Callable[[str], Features | None]],
    columns: Sequence[str],
    key: str = "canonical_smiles",
    partitions: int | None = None,
) -> DataFrame:
    """Add a canonical key and descriptor columns computed by a user-given per-row function.

    ``make_featurizer`` runs once per task, so a chemistry library loads once. Its function gets
    one non-blank text and returns ``(key, {column: number})``, or ``None`` (or raises) when the
    text is invalid. An invalid row is kept with a null key and null descriptors.
    Set ``partitions`` to spread a slow function over more tasks than the input has.
    """
    source = df.repartition(partitions) if partitions else df
    kept = [f for f in df.schema.fields if f.name != key and f.name not in columns]
    schema = T.StructType(
        [*kept, T.StructField(key, T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns]
    )
    kept_names, names = [f.name for f in kept], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = make_featurizer()
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in pieces(whole.column(text_col))):
            found = [_featurize_one(featurize, text) for text in batch.column(text_col).to_pylist()]
            # the other columns pass through as they are
            arrays = [batch.column(c) for c in kept_names]
            arrays.append(pa.array([k for k, _ in found], pa.string()))
            arrays += [pa.array([_number(values.get(c)) for _, values in found], pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def _featurize_one(featurize: Callable[[str], Features | None], text: object) -> Features:
    if not isinstance(text, str) or not text.strip():
        return None, {}
    try:
        return featurize(text) or (None, {})
    except Exception:  # an unreadable text is a row without descriptors, not a failed job
        return None, {}


def _number(value: object) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if number != number else number


def join_descriptors(df: DataFrame, descriptors: DataFrame, key: str) -> DataFrame:
    """Descriptors from a ready table; rows without a match keep nulls. No Python.

    The table counts with one row per key, whichever it is, so no row of ``df`` is doubled. Rows with a null key
    match nothing and do not go through the join, where all of them would meet in one task.
    """
    added = [c for c in descriptors.columns if c != key]
    once = descriptors.where(col(key).isNotNull()).dropDuplicates([key])
    joined = df.where(col(key).isNotNull()).join(once, on=key, how="left").select(*[col(c) for c in [*df.columns, *added]])
    nulls = [F.lit(None).cast(descriptors.schema[c].dataType).alias(c) for c in added]
    return joined.unionAll(df.where(col(key).isNull()).select(*[col(c) for c in df.columns], *nulls))


def expand_vector(df: DataFrame, vector: str, prefix: str, size: int) -> DataFrame:
    """Array column to ``prefix1 .. prefixN``; short or null arrays leave nulls."""
    values = [
        F.try_element_at(col(vector), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(1, size + 1)
    ]
    return df.select(*[col(c) for c in df.columns if c != vector], *values)
