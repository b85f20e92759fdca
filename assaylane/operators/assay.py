"""Row filter of raw assay exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylane.functions.text import normalize_relation, strip
from assaylane.operators.columns import col, number


def filter_assay(
    df: DataFrame,
    target: str | None = "CHEMBL332",
    stype: str | None = "IC50",
    units: str | None = "nm",
    relation: str | None = "=",
    positive: bool = True,
    units_mode: str = "is",
) -> DataFrame:
    """Keep rows of one target, measurement type, unit and relation, with a positive value.

    A condition whose column is absent is skipped, as is one set to ``None``. With
    ``units_mode="not"`` the unit must differ, and a missing unit counts as different.
    """
    if units_mode not in ("is", "not"):
        raise ValueError("units_mode is 'is' or 'not'")
    present = set(df.columns)
    conditions: list[Column] = []
    if target is not None and "Target ChEMBL ID" in present:
        conditions.append(col("Target ChEMBL ID").cast("string") == target)
    if stype is not None and "Standard Type" in present:
        conditions.append(F.upper(col("Standard Type").cast("string")) == stype.upper())
    if units is not None and "Standard Units" in present:
        unit = col("Standard Units").cast("string")
        if units_mode == "is":
            conditions.append(F.lower(unit) == units.lower())
        else:
            conditions.append(~F.lower(strip(unit)).eqNullSafe(units.lower()))
    if relation is not None and "Standard Relation" in present:
        conditions.append(normalize_relation(col("Standard Relation")) == relation)
    if positive and "Standard Value" in present:
        conditions.append(number(df, "Standard Value") > 0)
    for condition in conditions:
        df = df.where(condition)
    return df


def filter_assay_other_units(df: DataFrame, target: str = "CHEMBL332", stype: str = "IC50") -> DataFrame:
    """Rows measured in any other unit, missing included; relation and value are not looked at."""
    return filter_assay(df, target, stype, relation=None, positive=False, units_mode="not")
