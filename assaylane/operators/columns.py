"""Column selection, coercion and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane import fixed
from assaylane.functions.numeric import numeric


def quoted(name: str) -> str:
    """A column name as written in SQL, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name."""
    return F.col(quoted(name))


def number(df: DataFrame, name: str) -> Column:
    """A column as doubles, without NaN. Text is read as numbers, numeric columns are only cast."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return numeric(col(name))
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def detect_column(df: DataFrame, candidates: Sequence[str], fragment: str | None = None) -> str:
    """First candidate present (case matters), else the first name that holds ``fragment`` in any case."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and fragment is not None:
        found = next((c for c in df.columns if fragment.lower() in c.lower()), None)
    if found is None:
        raise ValueError(f"none of {list(candidates)} among the columns: {', '.join(df.columns)}")
    return found


def structure_column(df: DataFrame) -> str:
    return detect_column(df, fixed.STRUCTURE_CANDIDATES, fixed.STRUCTURE_FRAGMENT)


def screen_structure_column(df: DataFrame) -> str:
    return detect_column(df, fixed.SCREEN_STRUCTURE_CANDIDATES)


def pick_id(df: DataFrame, row_index: str = fixed.ROW_INDEX) -> str:
    """Id column by the usual names, else the row index column."""
    return next((c for c in fixed.ID_CANDIDATES if c in df.columns), row_index)


def coerce_numeric(df: DataFrame, name: str, drop: bool = True) -> DataFrame:
    """Read a column as numbers; what is not a number becomes null, and its row is dropped if asked."""
    out = df.withColumn(name, number(df, name))
    return out.where(col(name).isNotNull()) if drop else out


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        [F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def conform(df: DataFrame, meta: Sequence[str], targets: Sequence[str], key: str | None = None) -> DataFrame:
    """Meta columns that are present, then the key, then every target column; absent targets are null."""
    kept = [col(c) for c in meta if c in df.columns]
    if key is not None:
        kept.append(col(key))
    padded = [
        (col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in targets
    ]
    return df.select(*kept, *padded)


def feature_columns(df: DataFrame, forbidden: Sequence[str] = tuple(fixed.NOT_FEATURES)) -> list[str]:
    """Numeric and boolean columns that may be used as features."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in forbidden]


def align_features(df: DataFrame, required: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the trained features in the trained order, as doubles; absent ones are null."""
    others = [col(c) for c in keep if c not in required]
    return df.select(
        *others,
        *[
            (col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c)
            for c in required
        ],
    )


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the number of values in each column."""
    return df.agg(*[F.count(col(c)).alias(c) for c in cols])


def non_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least one value, found in one pass."""
    if not cols:
        return []
    counts = non_null_counts(df, cols).first().asDict()
    return [c for c in cols if counts[c] > 0]


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any required column."""
    return df.dropna("any", subset=list(required)) if required else df


def completeness(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Row counts before and after ``drop_incomplete``, in one pass."""
    complete = F.lit(True)
    for c in required:
        complete = complete & col(c).isNotNull()
    return df.agg(F.count("*").alias("rows_before"), F.count_if(complete).alias("rows_after"))


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop those of ``cols`` that hold no value at all."""
    supported = set(non_null_columns(df, cols))
    return df.drop(*[c for c in cols if c not in supported])


def preview(df: DataFrame, cols: Sequence[str], n: int, order_by: str) -> DataFrame:
    """First ``n`` rows in a given order, of the columns that are present."""
    present = [c for c in cols if c in df.columns]
    carried = [col(c) for c in present] + ([col(order_by)] if order_by not in present else [])
    return df.select(*carried).orderBy(col(order_by)).limit(n).select(*[col(c) for c in present])
