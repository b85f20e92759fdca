"""Alert catalogues and drug-likeness rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane.batches import pieces
from assaylane.functions.literals import required_literal
from assaylane.functions.rules import lipinski_violations, veber_violations
from assaylane.operators.columns import col

LITERAL_BYTES = 16 << 20  # literals of a catalogue that are searched at once

Predicate = Callable[[Column, Column], Column]


def match_patterns(
    df: DataFrame, text_col: str, patterns: Mapping[str, str] | Iterable[tuple[str, str]], prefix: str
) -> DataFrame:
    """Add ``<prefix>_flag`` (0/1) and ``<prefix>_terms`` for ``{term: regular expression}``.

    Terms are distinct, sorted and ``|``-joined; null text gives 0 and ``""``. Patterns that are
    not valid are skipped. A plain projection: no join, no shuffle.
    """
    pairs = list(patterns.items()) if isinstance(patterns, Mapping) else list(patterns)
    return _match_inline(df, text_col, _usable(df, pairs, F.rlike), F.rlike, prefix)


def match_catalog(
    df: DataFrame,
    text_col: str,
    catalog: DataFrame,
    prefix: str,
    predicate: Predicate = F.rlike,
    literal_bytes: int = LITERAL_BYTES,
) -> DataFrame:
    """Match a ``(pattern, description)`` table; the result is as in ``match_patterns``.

    ``predicate(text, pattern)`` is a regular-expression match unless another is given (such as ``F.contains``). What
    every match of an entry must hold is a literal of an inverted index from literals to entries. One search over a
    text finds its literals, and only the entries of those are verified. Entries without a literal are conditions that
    all rows are tested with. It is a projection over the one text column for a catalogue of any size: no join, no
    shuffle, no pass per entry; an index of more than ``literal_bytes`` is searched in several pieces.
    """
    described = F.coalesce("description", F.lit(f"{prefix}_match")).alias("description")
    rows = catalog.where("pattern is not null").select(described, "pattern").distinct().collect()
    pairs = _usable(df, sorted((r["description"], r["pattern"]) for r in rows), predicate)
    needed = [_literal_of(pattern, predicate) for _, pattern in pairs]
    plain = [pair for pair, literal in zip(pairs, needed) if not literal]
    indexed = [(*pair, literal) for pair, literal in zip(pairs, needed) if literal]
    if not indexed:
        return _match_inline(df, text_col, plain, predicate, prefix)
    found = [F.when(hit, F.lit(term)) for term, hit in _terms_by_name(text_col, plain, predicate).items()]
    terms = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    text = col(text_col).cast("string")
    for piece in _pieces(indexed, literal_bytes):
        descriptions = F.lit([d for d, _, _ in piece])
        patterns = F.lit([p for _, p, _ in piece])
        candidates = _entries_with_literals([literal for _, _, literal in piece])(text)
        verified = F.filter(candidates, lambda i: predicate(text, F.get(patterns, i)))
        terms = F.concat(terms, F.transform(verified, lambda i: F.get(descriptions, i)))
    return _with_terms(df, terms, prefix)


def _literal_of(pattern: str, predicate: Predicate) -> str:
    if predicate is F.rlike:
        return required_literal(pattern)
    return pattern if predicate is F.contains else ""


def _pieces(entries: Sequence[tuple[str, str, str]], most: int) -> Iterator[list[tuple[str, str, str]]]:
    """Entries in lists with literals of at most ``most`` bytes together."""
    held, size = [], 0
    for entry in entries:
        n = len(entry[2].encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(entry)
        size += n
    yield held


def _mapped(texts: pa.Array, fn: Callable, kind: pa.DataType) -> pa.Array:
    """``fn`` of every text, piece by piece, as the texts of a batch take a multiple of its size as Python objects."""
    return pa.concat_arrays([pa.array(map(fn, texts.slice(a, b - a).to_pylist()), kind) for a, b in pieces(texts)])


def _entries_with_literals(literals: Sequence[str]):
    """A function of texts that lists the places of the literals that occur in each, found in one search."""

    @F.arrow_udf("array<int>")
    def entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, list[int]] = {}
        for i, literal in enumerate(literals):
            places.setdefault(literal, []).append(i)
        automaton = ahocorasick.Automaton()
        for literal, own in places.items():
            automaton.add_word(literal, own)
        automaton.make_automaton()

        def search(text: object) -> list[int] | None:
            if not isinstance(text, str):
                return None
            hits: set[int] = set()
            for _, own in automaton.iter(text):
                hits.update(own)
            return sorted(hits)

        for batch in batches:
            yield _mapped(batch, search, pa.list_(pa.int32()))

    return entries


def _usable(df: DataFrame, pairs: list[tuple[str, str]], predicate: Predicate) -> list[tuple[str, str]]:
    """Entries without those whose regular expression is not valid."""
    if predicate is not F.rlike:
        return pairs
    valid = set(valid_patterns(df.sparkSession, [p for _, p in pairs]))
    return [(term, p) for term, p in pairs if p in valid]


def _terms_by_name(text_col: str, pairs: Iterable[tuple[str, str]], predicate: Predicate) -> dict[str, Column]:
    """One condition per term, terms in the order of the joined list."""
    found: dict[str, Column] = {}
    for term, pattern in sorted(set(pairs)):
        hit = predicate(col(text_col), F.lit(pattern))
        found[term] = found[term] | hit if term in found else hit
    return found


def _match_inline(
    df: DataFrame, text_col: str, pairs: Iterable[tuple[str, str]], predicate: Predicate, prefix: str
) -> DataFrame:
    """Terms are joined in the order of their conditions, so nothing is sorted per row."""
    by_term = _terms_by_name(text_col, pairs, predicate)
    flagged = F.col("_terms") != ""
    if "" in by_term:
        flagged = flagged | F.coalesce(by_term[""], F.lit(False))
    listed = df.withColumn("_terms", F.concat_ws("|", *[F.when(hit, F.lit(t)) for t, hit in by_term.items()]))
    columns = {f"{prefix}_flag": flagged.cast("int"), f"{prefix}_terms": F.col("_terms")}
    return listed.withColumns(columns).drop("_terms")


def match_terms_with(
    df: DataFrame, text_col: str, make_matcher: Callable[[], Callable[[str], Iterable[str] | None]], prefix: str
) -> DataFrame:
    """Match with a user-given function ``text -> terms``, such as a substructure search.

    ``make_matcher`` runs once per task, so a catalogue is built once there. ``None`` (or an
    exception) means an invalid text: flag 0, no terms.
    """

    @F.arrow_udf("array<string>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = make_matcher()

        def one(text: object) -> list[str]:
            if not isinstance(text, str):
                return []
            try:
                return list(match(text) or [])
            except Exception:
                return []

        for batch in batches:
            yield _mapped(batch, one, pa.list_(pa.string()))

    return _with_terms(df, terms(col(text_col)), prefix)


def _with_terms(df: DataFrame, found: Column, prefix: str) -> DataFrame:
    none = F.array().cast("array<string>")
    listed = df.withColumn("_terms", F.coalesce(F.sort_array(F.array_distinct(found)), none))
    return listed.withColumns(
        {
            f"{prefix}_flag": (F.size("_terms") > 0).cast("int"),
            f"{prefix}_terms": F.array_join("_terms", "|"),
        }
    ).drop("_terms")


def valid_patterns(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Those patterns that Spark's regular expressions (Java's) accept."""
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile

    def valid(pattern: str) -> bool:
        try:
            compile_(pattern)
        except (IllegalArgumentException, Py4JJavaError):
            return False
        return True

    return [p for p in dict.fromkeys(patterns) if valid(p)]


def with_druglikeness(df: DataFrame) -> DataFrame:
    """Lipinski and Veber violation counts from the descriptor columns."""
    hba, hbd = col("NumLipinskiHBA"), col("NumLipinskiHBD")
    return df.withColumns(
        {
            "Lipinski_violations": lipinski_violations(hba, hbd, col("AMW"), col("SlogP")),
            "Veber_violations": veber_violations(col("TPSA"), hba, hbd, col("NumRotatableBonds")),
        }
    )


SCREENS = ("pains", "chelators", "druglikeness")


def apply_screens(
    df: DataFrame,
    screens: Sequence[str] | str = (),
    pains: Callable[[DataFrame], DataFrame] | None = None,
    chelators: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Apply any of ``pains``, ``chelators`` and ``druglikeness``, or ``"all"``; none leaves ``df`` as is.

    The two alert screens are given as functions that add their columns, for instance
    ``lambda d: match_catalog(d, "Smiles", catalog, "PAINS")``.
    """
    chosen = SCREENS if screens == "all" else tuple([screens] if isinstance(screens, str) else screens)
    unknown = set(chosen) - set(SCREENS)
    if unknown:
        raise ValueError(f"unknown screens: {sorted(unknown)}")
    for name, add in (("pains", pains), ("chelators", chelators)):
        if name in chosen:
            if add is None:
                raise ValueError(f"the {name} screen needs a matcher")
            df = add(df)
    return with_druglikeness(df) if "druglikeness" in chosen else df


def screen_summary(df: DataFrame) -> DataFrame:
    """One row: flagged rows per alert screen, and rows without violations per rule set."""
    counts = {
        "PAINS_flag": ("pains_flagged", 1),
        "Chelator_flag": ("chelator_flagged", 1),
        "Lipinski_violations": ("lipinski_ok", 0),
        "Veber_violations": ("veber_ok", 0),
    }
    present = {c: v for c, v in counts.items() if c in df.columns}
    if not present:
        raise ValueError("the table has no screen columns")
    return df.agg(*[F.count_if(col(c) == wanted).alias(name) for c, (name, wanted) in present.items()])
