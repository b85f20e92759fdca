"""Language identification by prediction by partial matching (operator 4).

Each language has a tree of byte contexts of up to three bytes. The cost of a byte is the length of
its exact code in bits: it is coded in the longest context that is known, or that context escapes to
the next shorter one (method C, with exclusion of what longer contexts hold), down to equal shares of
all bytes. A text gets the language in which it is shortest; the statistics are frozen after
training. ``score`` is the probability of that language among all, each as likely beforehand.

Training takes a bounded sample: about ``SAMPLE_BYTES`` of text for each language, chosen by a hash of
the text, and no more than ``MAX_LANGUAGES`` languages. That bounds the model, which goes to all tasks.
Prediction reads every whole text, in pieces, with no more state than the sums.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no language
learned everything is ``und``; repeated rows each get a result; a null id is neither held out nor a
hindrance; other columns are ignored whatever their names; ties go to the first language by name.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from assaylane.llm.common import chunks_by_size, tidy_batches, worker_cache
from assaylane.llm.words import text_chunks

ORDER = 3
SAMPLE_BYTES = 2 << 20  # of training text for each language
MAX_LANGUAGES = 256
UNKNOWN = "und"

_SLOTS = 1 << 22
_KNOWN = 1 << 21  # grams a worker remembers
_PIECE = 1 << 19  # bytes scored at a time
_CHUNK = 1 << 20  # bytes of texts that become Python objects at a time; a longer text is alone


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the three before it, as 32 bits; and where each text starts. Before a text are zeros."""
    joined = b"".join(b"\0" * ORDER + t for t in texts)
    a = np.frombuffer(joined, np.uint8).astype(np.uint32)
    grams = a.copy()
    for k in range(1, ORDER + 1):
        grams[k:] |= a[:-k] << np.uint32(8 * k)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ORDER) - sizes
    keep = np.ones(len(a), bool)
    for k in range(1, ORDER + 1):
        keep[starts - k] = False
    return grams[keep], np.cumsum(sizes) - sizes


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(name, []).append(value.encode())
            for name, texts in by.items():
                grams, n = np.unique(grams_of(texts)[0], return_counts=True)
                yield pa.record_batch(
                    [pa.array([name] * len(n), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    return (
        docs.select(F.col(lang).cast("string"), F.col(text).cast("string"))
        .mapInArrow(tidy_batches(count), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


class Tree:
    """Contexts of one language, as sorted arrays per length: the symbols after each, their sum and number, and what of
    these a context leaves of the next shorter one."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.symbols: list[tuple[np.ndarray, np.ndarray]] = []  # context and symbol, count
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # context, sum, number of symbols
        self.left: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        for k in range(ORDER + 1):
            parts, back = np.unique(grams & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.zeros(len(parts), np.int64)
            np.add.at(n, back, counts)
            context, first = np.unique(parts >> np.uint32(8), return_index=True)
            self.symbols.append((parts, n))
            self.contexts.append((context, np.add.reduceat(n, first) if len(first) else n, np.diff(np.append(first, len(parts)))))
            if k:
                shorter, held = self.symbols[k - 1], parts & np.uint32((1 << 8 * k) - 1)
                here = np.searchsorted(self.contexts[k - 1][0], context & np.uint32((1 << 8 * (k - 1)) - 1))
                total, distinct = (x[here] for x in self.contexts[k - 1][1:])
                held = shorter[1][np.searchsorted(shorter[0], held)]
                self.left.append((total - (np.add.reduceat(held, first) if len(first) else held), distinct - self.contexts[k][2]))

    def bits(self, grams: np.ndarray | int) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        grams = np.atleast_1d(np.asarray(grams, np.uint32))
        cost, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
        longer = np.full(len(grams), -1)  # the next longer context, which is known if any longer one is
        for k in range(ORDER, -1, -1):
            context, total, distinct = self.contexts[k]
            at, known = _places(context, (grams & np.uint32((1 << 8 * (k + 1)) - 1)) >> np.uint32(8))
            own_total, own_distinct = np.where(known, total[at], 0), np.where(known, distinct[at], 0)
            if k < ORDER:
                less = longer >= 0
                own_total[less], own_distinct[less] = (x[longer[less]] for x in self.left[k + 1])
            symbol, found = _places(self.symbols[k][0], grams & np.uint32((1 << 8 * (k + 1)) - 1))
            live = ~done & known & (own_distinct > 0)
            end, escape = live & found, live & ~found
            cost[end] -= np.log2(self.symbols[k][1][symbol[end]] / (own_total + own_distinct)[end])
            cost[escape] -= np.log2(own_distinct[escape] / (own_total + own_distinct)[escape])
            done |= end
            longer = np.where(known, at, -1)
        cost[~done] += math.log2(256 - int(self.contexts[0][2][0])) if not done.all() else 0.0
        return cost


def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array that is not empty, and whether it is."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Model:
    """Languages and their gram counts; small enough to send."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.name = uuid.uuid4().hex
        self.languages = sorted(counts)
        self.counts = [counts[name] for name in self.languages]


class Scorer:
    """Code lengths of texts under all languages. Costs of grams are worked out once and looked up."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.trees = [Tree(*c) for c in counts]
        self.reset()

    def reset(self) -> None:
        self.known = 0
        self.grams = np.zeros(1 << 12, np.uint32)
        self.costs = np.zeros((1 << 12, len(self.trees)), np.float32)
        self.sorted, self.row_of = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.slots = np.zeros(_SLOTS, np.int32)

    def _rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of distinct sorted grams; those that are not known get new ones."""
        at = np.searchsorted(self.sorted, grams)
        new = np.ones(len(grams), bool)
        if len(self.sorted):
            new = self.sorted[np.minimum(at, len(self.sorted) - 1)] != grams
        rows = np.zeros(len(grams), np.int32)
        rows[~new] = self.row_of[at[~new]]
        rows[new] = np.arange(self.known, self.known + np.count_nonzero(new))
        self.known += np.count_nonzero(new)
        while self.known > len(self.grams):
            self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        if new.any():
            self.grams[rows[new]] = grams[new]
            for i, tree in enumerate(self.trees):
                self.costs[rows[new], i] = tree.bits(grams[new])
            self.sorted, self.row_of = np.insert(self.sorted, at[new], grams[new]), np.insert(self.row_of, at[new], rows[new])
        return rows

    def rows(self, grams: np.ndarray) -> np.ndarray:
        if self.known > _KNOWN:
            self.reset()
        place = (grams * np.uint32(2654435761)) >> np.uint32(10)
        rows = self.slots[place]
        missed = np.flatnonzero(self.grams[rows] != grams) if self.known else np.arange(len(grams))
        if len(missed):
            new, where, back = np.unique(grams[missed], return_index=True, return_inverse=True)
            found = self._rows_of(new)
            self.slots[place[missed[where]]] = found
            rows[missed] = found[back]
        return rows

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.trees)))
        most = max(1 << 12, 4 * _PIECE // max(1, len(self.trees)))
        for begin, end in chunks_by_size(map(len, texts), most):
            grams, starts = grams_of(texts[begin:end])
            ends = np.append(starts[1:], len(grams))
            full = np.flatnonzero(ends > starts)
            for a in range(0, len(grams), most):  # a long text in pieces
                b = min(a + most, len(grams))
                inside = full[(starts[full] < b) & (ends[full] > a)]
                rows = self.rows(grams[a:b])  # may replace the tables
                costs = self.costs[rows]
                at = np.maximum(starts[inside], a) - a
                out[begin + inside] += np.add.reduceat(costs, at, axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Context trees from the rows of ``docs`` that have a text and a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    span = 1 << 30
    share = {r["lang"]: min(span, math.ceil(span * sample_bytes / max(1, r["n"]))) for r in sizes}
    if not share:
        return Model({})
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(span)) < limit)
    rows = count_grams(sample, "lang", "text").toPandas()
    return Model(
        {
            name: (own["gram"].to_numpy().astype(np.uint32), own["n"].to_numpy())
            for name, own in rows.sort_values(["lang", "gram"]).groupby("lang")
        }
    )


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` and ``bits_per_byte`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.name, model.languages, model.counts))  # plain data
    names = [f"kept{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("string").alias("text"))
    out = named.drop("text").withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0).cast("double")}
    )
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, languages, counts = sent.value
        scorer = worker_cache(("ppm", name), lambda: Scorer(counts), large="ppm") if languages else None
        for batch in (chunk for whole in batches for chunk in text_chunks(whole, "text", _CHUNK)):
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column("text").to_pylist()]
            raw = [t.encode() for t in texts]
            predicted, score, rate = [], [], []
            bits = scorer.lengths(raw) if scorer else np.zeros((len(raw), 1))
            for value, own in zip(raw, bits, strict=True):
                if not value or not scorer:
                    predicted.append(UNKNOWN)
                    score.append(0.0)
                    rate.append(0.0)
                    continue
                best = int(own.argmin())
                predicted.append(languages[best])
                score.append(float(1 / np.exp2(np.maximum(own[best] - own, -1000.0)).sum()))
                rate.append(float(own[best]) / len(value))
            columns = [*(batch.column(n) for n in names), pa.array(predicted), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    predicted = named.mapInArrow(tidy_batches(run), out.schema)
    return predicted.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score", "bits_per_byte"
    )


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
