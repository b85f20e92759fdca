from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane.batches import pieces
from assaylane.fixed import TRUE_TEXTS

WHITE_SPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends (SQL ``trim`` drops plain spaces only)."""
    return F.trim(col, F.lit(WHITE_SPACE))


def safe_float(col: Column) -> Column:
    """Number in a text, else null. Takes decimal notation only, so not ``1.5d`` or ``0x1p3``."""
    text = strip(col.cast("string"))
    return F.when(text.rlike(r"^([^dDfFxX]*|[+-]?(?i:inf|infinity))$"), text.try_cast("double"))


def normalize_relation(col: Column) -> Column:
    """``" '=' "`` -> ``"="``; null -> ``""``."""
    return strip(F.trim(strip(F.coalesce(col.cast("string"), F.lit(""))), F.lit("\"'")))


def truthy(col: Column) -> Column:
    """Flag text to boolean. Missing, empty and zero are false; any other text is true, even ``no``."""
    text = F.lower(strip(col.cast("string")))
    zero = safe_float(text) == 0
    missing = col.isNull() | F.coalesce(col.try_cast("string") == "NaN", F.lit(False))
    return (
        F.when(missing, F.lit(False))
        .when(text.isin(TRUE_TEXTS), F.lit(True))
        .otherwise((text != "") & ~F.coalesce(zero, F.lit(False)))
    )


def _plain(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@F.arrow_udf(T.StringType())
def _to_ascii(texts: pa.Array) -> pa.Array:
    """Piece by piece, as the texts of a batch and their decomposed forms take many times its size."""
    done = [pa.array(map(_plain, texts.slice(a, b - a).to_pylist()), texts.type) for a, b in pieces(texts)]
    return pa.concat_arrays(done)


def clean_text(col: Column) -> Column:
    """One line of plain ASCII: accents dropped, line breaks to spaces, ends stripped; null -> ``""``.

    Only texts with non-ASCII characters are handed to Python, the rest go there as nulls.
    """
    text = strip(F.coalesce(col.cast("string"), F.lit("")))
    foreign = text.rlike(r"[^\x00-\x7F]")
    ascii_text = F.when(foreign, _to_ascii(F.when(foreign, text))).otherwise(text)
    return strip(F.translate(ascii_text, "\r\n", "  "))
