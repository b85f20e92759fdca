"""Importance resampling towards a target distribution (operator 12).

Features are runs of one to three words, hashed into buckets. Two passes of counts, one over the documents
and one over the target texts, give an array of gains, one for each bucket: the logarithm of how much more
frequent the bucket is in the target. A document's weight is the sum of the gains of its features, looked up
in that array. A seeded Gumbel number is added, so that the highest scores are a sample without replacement in
proportion to the weights. The draw is a distributed LSD radix sort by score and id, after a histogram of the
scores has put aside those that cannot be drawn.

Only the counts, ``BUCKETS`` numbers for each side, meet on the driver and go to the tasks.

Defined results: null and empty texts have no features and the weight 0; documents of fewer than ``least``
words are not drawn; ties go to smaller ids, null ids last (a null id counts as an empty one in the seeded
number), then to fewer features; repeated rows are documents of their own; other columns are ignored; with an
empty target all buckets gain by the documents' counts alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm.common import tidy_batches
from assaylane.llm.radix import radix_sorted
from assaylane.llm.words import ALPHANUMERIC, Words, find_words, run_crcs, text_chunks
from assaylane.session import materialize

BUCKETS, RUN = 10_000, 3
LEAST_WORDS, SEED = 20, 42
SCORE_BINS = 4_096


def _buckets(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the bucket of each, and whether it lies in one text."""
    end = np.repeat(words.first[1:], words.counts)
    for n, crc in enumerate(run_crcs(words, RUN), 1):
        yield crc % np.uint32(BUCKETS), np.arange(len(crc)) + n <= end[: len(crc)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket occurs in the texts of a task: one row."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in text_chunks(batch, "text"):
            for bucket, inside in _buckets(find_words(part.column("text"), ALPHANUMERIC)):
                total += np.bincount(bucket[inside], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of features per bucket; ``BUCKETS`` rows go to the driver."""
    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(tidy_batches(_count), "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of every bucket."""
    s, t = float(documents.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(documents.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)) of a number u that follows from seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _score(gain: np.ndarray, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                words = find_words(part.column("text"), ALPHANUMERIC)
                weight, features = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for bucket, inside in _buckets(words):
                    for out, values in ((weight, np.where(inside, gain[bucket], 0)), (features, inside)):
                        upto = np.concatenate([[0], np.cumsum(values), np.zeros(RUN, np.int64)])
                        upto[len(bucket) + 1 :] = upto[len(bucket)]
                        out += upto[words.first[1:]] - upto[words.first[:-1]]
                noise = np.array([gumbel(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                columns = (words.counts, features, weight, weight + noise)
                yield pa.record_batch(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return score


def scored_documents(docs: DataFrame, target: DataFrame, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy_batches(_score(gain, seed)), _SCORED)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least: int = LEAST_WORDS, seed: int = SEED, text: str = "text",
    key: str = "doc_id", digit_bits: int = 11, tile: int | None = None,
) -> DataFrame:
    """n_features, weight, score and rank of every row; the rank is null for rows that are not drawn."""
    scored = materialize(scored_documents(docs, target, seed, text, key))
    may = scored.where(F.col("n_words") >= least)
    facts = may.agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"), F.max("n_features").alias("features"),
    ).first()
    wanted = percent * facts["n"] // 100
    columns = [F.col("doc_id").alias(key), "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # the scores that may be drawn: those from the bin of the last one on
    width = (facts["high"] - facts["low"]) // SCORE_BINS + 1
    bins = may.groupBy(F.floor((F.lit(facts["high"]) - F.col("score")) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    upto, cut = 0, 0
    for cut, n in sorted(bins.collect()):  # noqa: B007  at most SCORE_BINS rows
        upto += n
        if upto >= wanted:
            break
    lowest = max(facts["low"], facts["high"] - (cut + 1) * width + 1)
    in_draw = (F.col("n_words") >= least) & (F.col("score") >= lowest)
    first = facts["first"] or 0
    after = (facts["last"] or 0) - first + 1
    keyed = scored.where(in_draw).select(
        *(c for c in scored.columns if c != "n_words"),
        (F.lit(facts["high"]) - F.col("score")).alias("k0"),
        F.coalesce(F.col("doc_id") - first, F.lit(after)).alias("k1"),
        F.col("n_features").alias("k2"),
    )
    widths = [(facts["high"] - lowest).bit_length(), after.bit_length(), facts["features"].bit_length()]
    ranked = radix_sorted(keyed, widths, ["k0", "k1", "k2"], "place", digit_bits, tile)
    drawn = ranked.select(*columns, F.when(F.col("place") < wanted, F.col("place") + 1).alias("rank"))
    return drawn.union(scored.where(~in_draw).select(*columns, F.lit(None).cast("long").alias("rank")))


def brute_force(rows: list[tuple[int | None, str | None]], target: list[str | None], percent: int = 5) -> list[tuple]:
    """What must come out, feature by feature; for tests."""
    import re
    import zlib

    def features(text: str | None) -> tuple[int, list[int]]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = (" ".join(words[i : i + n]) for n in range(1, RUN + 1) for i in range(len(words) - n + 1))
        return len(words), [zlib.crc32(r.encode()) % BUCKETS for r in runs]

    own = [(i, *features(t)) for i, t in rows]
    counts = [np.bincount(np.array([f for x in texts for f in x], np.int64), minlength=BUCKETS) for texts in ([f for _, _, f in own], [features(t)[1] for t in target])]
    gain = gains(*counts).tolist()
    scored = [(i, n, len(f), sum(gain[b] for b in f)) for i, n, f in own]
    scored = [(i, n, m, w, w + gumbel(i)) for i, n, m, w in scored]
    may = sorted((r for r in scored if r[1] >= LEAST_WORDS), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = may[: percent * len(may) // 100]
    out = [(r[0], *r[2:], rank) for rank, r in enumerate(drawn, 1)]
    rest = list(scored)
    for r in drawn:
        rest.remove(r)
    return out + [(r[0], *r[2:], None) for r in rest]
