"""Literal texts that every match of a regular expression holds."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

# written differently, or not at all, in one of the two dialects: such patterns get no literal
_OTHER = re.compile(r"&&|\\[QEvhHRXGbB0-9ckpPxuN]|\(\?[^:=!<]|\[[^\]]*\[|#")
_REPEATS = {sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT}


def required_literal(pattern: str) -> str:
    """The longest text that is part of every match; ``""`` if none is sure.

    Careful on purpose: Spark's expressions are Java's, so a pattern whose reading could differ gets none.
    """
    if _OTHER.search(pattern):
        return ""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    return max(_runs(parsed), key=len, default="")


def _runs(parsed) -> list[str]:
    """Runs of literal characters that must follow one another in any match."""
    runs = [""]
    for op, value in parsed:
        if op is sre.LITERAL:
            runs[-1] += chr(value)
        elif op is sre.SUBPATTERN:
            _, add, drop, inner = value
            if add or drop:
                runs.append("")
                continue
            first, *rest = _runs(inner)
            runs[-1] += first
            runs += rest
        elif op in _REPEATS and value[0] >= 1:
            runs += [*_runs(value[2]), ""]
        else:  # choices, classes, anchors: what comes next starts a run of its own
            runs.append("")
    return runs
