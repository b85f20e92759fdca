"""Column -> Column functions."""

from assaylane.functions.numeric import (
    class_text,
    classify,
    first_available,
    numeric,
    round3,
)
from assaylane.functions.rules import count_violations, lipinski_violations, veber_violations
from assaylane.functions.seeds import seed_hash
from assaylane.functions.text import clean_text, normalize_relation, safe_float, strip, truthy

__all__ = [
    "class_text", "classify", "clean_text", "count_violations", "first_available", "lipinski_violations",
    "normalize_relation", "numeric", "round3", "safe_float", "seed_hash", "strip", "truthy",
    "veber_violations",
]
