from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylane.functions.numeric import total


def count_violations(rules: Sequence[Column], inputs: Sequence[Column] = ()) -> Column:
    """How many of the rules are broken; null when any input is missing (an invalid row)."""
    broken = total([F.when(rule, 1).otherwise(0) for rule in rules])
    if not inputs:
        return broken
    present = F.lit(True)
    for value in inputs:
        present = present & value.isNotNull()
    return F.when(present, broken)


def lipinski_violations(hba: Column, hbd: Column, weight: Column, logp: Column) -> Column:
    rules = [hba > 10, hbd > 5, weight > 500, logp > 5]
    return count_violations(rules, [hba, hbd, weight, logp])


def veber_violations(tpsa: Column, hba: Column, hbd: Column, rotatable: Column) -> Column:
    rules = [~((tpsa <= 140) | (hba + hbd <= 12)), rotatable > 10]
    return count_violations(rules, [tpsa, hba, hbd, rotatable])
