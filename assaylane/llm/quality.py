"""Quality classifier (operator 2): an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of four bytes, counted per language over every trusted document. Documents are dealt
into blocks; a block gives each distinct gram it holds once, with its count in trusted text. The
counts of all blocks are summed in shards by gram, continuation counts of the shorter grams and the
discounts follow from them, and every distinct gram gets its code length by joins with the count
tables of each order. The code lengths go back to the blocks that hold the gram, where each document
is summed up. ``perplexity`` is per byte. One in five trusted documents is not trained on; the quantile of these
is the threshold of their language, or that of all of them where a language has none. A document is
kept if it is no worse; without such documents at all, everything with a text is kept.

Defined results: null and empty texts have a null perplexity and are not kept; a null language is one
of its own; repeated rows each get a result; an id is trusted if any of its labels is; a null id is
not; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylane.llm.common import chunks_by_size, parts_for, total_bytes
from assaylane.llm.ppm import grams_of
from assaylane.session import materialize

ORDER = 4
BLOCK_BYTES = 24 << 20
QUANTILE = 0.99
HELD_OUT = 5  # one in so many trusted documents is not trained on, but sets the threshold
_CHUNK = 1 << 21


def _by_language(docs: pa.Table):
    """(language, row numbers, texts) of the rows with a text."""
    langs, texts = docs.column("lang").to_pylist(), docs.column("text").to_pylist()
    rows: dict[str, list[int]] = {}
    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        if text:
            rows.setdefault(lang, []).append(i)
    for lang, own in rows.items():
        yield lang, np.array(own), [texts[i].encode() for i in own]


def _count(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct grams of a block, with their counts in trusted documents."""
    good = set(trusted.column("id").to_pylist())
    ids = docs.column("id").to_pylist()
    block = docs.column("block")[0].as_py() if len(docs) else None
    parts = []
    for lang, rows, texts in _by_language(docs):
        total: dict[str, list[np.ndarray]] = {"g": [], "n": []}
        for begin, end in chunks_by_size(map(len, texts), _CHUNK):
            grams, starts = grams_of(texts[begin:end])
            mine = np.array([ids[r] in good for r in rows[begin:end].tolist()])
            of_good = np.repeat(mine, np.diff(np.append(starts, len(grams))))
            unique, codes = np.unique(grams, return_inverse=True)
            total["g"].append(unique)
            total["n"].append(np.bincount(codes, weights=of_good, minlength=len(unique)))
        unique, codes = np.unique(np.concatenate(total["g"]), return_inverse=True)
        n = np.bincount(codes, weights=np.concatenate(total["n"])).astype(np.int64)
        parts.append((lang, unique.astype(np.int64), n))
    return pa.table(
        {
            "block": pa.array([block] * sum(len(g) for _, g, _ in parts), pa.int64()),
            "lang": pa.array([lang for lang, g, _ in parts for _ in range(len(g))], pa.string()),
            "gram": pa.array(np.concatenate([np.zeros(0, np.int64), *(g for _, g, _ in parts)])),
            "n": pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in parts)])),
        }
    )


def _score(docs: pa.Table, bits: pa.Table) -> pa.Table:
    """Perplexity of every document of a block."""
    bits = bits.sort_by([("lang", "ascending"), ("gram", "ascending")])
    langs = np.array(bits.column("lang").to_pylist(), dtype=object)
    grams_of_all, costs = bits.column("gram").to_numpy().astype(np.uint32), bits.column("bits").to_numpy()
    out = np.full(len(docs), np.nan)
    for lang, rows, texts in _by_language(docs):
        own = np.flatnonzero(langs == lang)
        known, cost = grams_of_all[own], costs[own]
        for begin, end in chunks_by_size(map(len, texts), _CHUNK):
            grams, starts = grams_of(texts[begin:end])
            sums = np.add.reduceat(cost[np.searchsorted(known, grams)], starts)
            sizes = np.diff(np.append(starts, len(grams)))
            out[rows[begin:end]] = np.exp2(sums / sizes)
    return pa.table({"id": docs.column("id"), "lang": docs.column("lang"), "perplexity": pa.array(out, mask=np.isnan(out))})


def _discount(n: str) -> Column:
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).when(F.col(n) > 2, F.col("d3")).otherwise(0.0)


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each language, from how many grams occur one to four times."""
    of = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    bound = lambda k, plain, c: F.least(F.lit(float(k)), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(plain))))
    part = lambda k: F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
    return of.select(
        "lang",
        bound(1, 0.5, 1 - 2 * y * part(1)).alias("d1"),
        bound(2, 1.0, 2 - 3 * y * part(2)).alias("d2"),
        bound(3, 1.5, 3 - 4 * y * part(3)).alias("d3"),
    )


def code_lengths(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """``bits`` of each (lang, gram) of ``grams`` under the model of ``counts`` (lang, gram, n), n over 0."""
    levels, level = {}, counts
    for k in range(ORDER, 0, -1):
        levels[k] = level
        if k > 1:  # how many different bytes come before the shorter gram
            level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("gram")).agg(F.count("*").alias("n"))
    out = grams.withColumn("p", F.lit(1 / 256))
    for k in range(1, ORDER + 1):
        rows = levels[k].join(_discounts(levels[k]), "lang").withColumn("context", F.shiftright("gram", 8))
        rows = rows.withColumn("off", _discount("n"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("free"))
        rest = rows.select("lang", F.col("gram").alias("part"), (F.col("n") - F.col("off")).alias("rest"))
        part = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        out = (
            out.withColumn("part", part)
            .withColumn("context", F.shiftright("part", 8))
            .join(rest, ["lang", "part"], "left")
            .join(contexts, ["lang", "context"], "left")
            .select(
                "lang",
                "gram",
                F.when(F.col("total").isNull(), F.col("p"))
                .otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("free") * F.col("p")) / F.col("total"))
                .alias("p"),
            )
        )
    return out.select("lang", "gram", (-F.log2("p")).alias("bits"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``key``, lang, perplexity, threshold and keep of every row. ``labels``: ``key`` and ``quality``."""
    blocks = parts_for(total_bytes(docs, text), BLOCK_BYTES)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block")
    named = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))
    dealt = named.select(block, "id", "lang", "text")
    trusted = labels.where("quality = 1").select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) == 0
    counted = (
        dealt.groupBy("block")
        .cogroup(trusted.where(~held).select(block, "id").groupBy("block"))
        .applyInArrow(_count, "block long, lang string, gram long, n long")
    )
    counted = materialize(counted)
    summed = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    bits = materialize(code_lengths(summed.where("n > 0"), summed.select("lang", "gram")))
    back = counted.select("block", "lang", "gram").join(bits, ["lang", "gram"]).select("block", "lang", "gram", "bits")
    scored = materialize(
        dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score, "id long, lang string, perplexity double")
    )
    good = scored.join(trusted.where(held), "id", "left_semi").where("perplexity IS NOT NULL")
    at = functools.partial(F.percentile_approx, "perplexity", quantile, 10_000)
    limits = good.groupBy("lang").agg(at().alias("own"))
    overall = good.agg(at().alias("overall")).first()["overall"]
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return scored.join(limits, "lang", "left").select(
        F.col("id").alias(key),
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"),
        "perplexity",
        threshold.alias("threshold"),
        (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("keep"),
    )
