"""Near-duplicate documents by DartMinHash (operator 10).

A document is a weighted set: its shingles of five words, each as heavy as it is frequent. Over every
unit of weight of an element lies a Poisson process of darts, a function of element and unit alone.
A dart has a time and a coordinate of the signature; the earliest dart of each coordinate that hits
the document is kept. Two signatures agree in a coordinate with the probability of the weighted
Jaccard similarity (sum of minima over sum of maxima). Darts are thrown up to a time at which almost
all coordinates are hit, so the work is about one look per element; later times follow for the rest.

Bands of four coordinates are the keys of the join: at similarity 0.8, a pair shares none of the 24
bands with a probability of 4e-6. Documents with equal weighted sets are one class from the start. Sets that share a
key are compared exactly, on their units of weight, and no key is expanded into all its pairs; see ``linking``. The
sets of candidates are made again from their texts in a scan that a bitmap of the candidates thins out, so texts do not
move.

Result: one row per document with its class, the least id in it, and the size of the class.

Defined results: null texts and texts without words are alone (those with null ids too, but rows whose made ids agree, as
those of null texts do, count as one document); a text of fewer than five words is one
shingle; repeated rows share a class; rows that share an id count as versions of one document and
join their classes; rows with a null id take a negative id derived from the text for ``class_id``; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylane.llm.bitmaps import bitmap_of, in_bitmap
from assaylane.llm.common import chunks_by_size, mixed, tidy_batches
from assaylane.llm.components import components
from assaylane.llm.linking import DETAILS, detail_arrays, linked, with_sizes
from assaylane.llm.pretokens import LETTER, NUMBER, char_classes
from assaylane.session import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
_CHUNK = 1 << 20


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased; the same rule as the arrays below, for tests."""
    kind = char_classes()
    out, held = [], ""
    for c in text.lower():
        if kind[ord(c)] in (LETTER, NUMBER):
            held += c
        elif held:
            out.append(held)
            held = ""
    return out + [held] * bool(held)


def shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the text of each."""
    joined = "\n".join(t.lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = char_classes()[points]
    word = (kind == LETTER) | (kind == NUMBER)
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.arange(len(points)) - np.repeat(np.append(starts, len(points)), np.diff(np.concatenate([[0], starts[1:], [len(points)] * 2])))
    terms = np.where(word, (points.astype(np.uint64) + np.uint64(1)) * mixed(inside.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    hashes = mixed(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t.lower()) + 1 for t in texts[:-1])])
    owner = np.searchsorted(begins, starts, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(texts)))
    last = np.searchsorted(owner, np.arange(len(texts)), side="right")
    counts = np.where(last > first, np.maximum(last - first - size + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    of = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inner = at + k < last[of]
        piece = np.where(inner, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + piece + np.uint64(k))
    return out, of


def units(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of weight: a shingle that comes n times in a text has the units 0 to n - 1."""
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(hashes)) - np.repeat(begin, np.diff(np.append(begin, len(hashes))))
    return mixed(hashes + mixed(nth.astype(np.uint64) + np.uint64(77))), of


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(cells: np.ndarray, of: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, for n texts given by their units of weight. 0: no unit."""
    out = np.zeros((n, k), np.uint64)
    weight = np.bincount(of, minlength=n)
    todo = np.flatnonzero(weight > 0)
    reach = k * (math.log(k) + 3)
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = reach / weight[todo]
        live = limit[of] > 0
        unit, owner = cells[live], of[live]
        time, darts = np.zeros(len(unit)), []
        step = np.zeros(1, np.uint64)
        while len(unit):
            step = step + np.uint64(1)
            dart = mixed(unit ^ mixed(step))
            time = time - np.log(_uniform(dart))
            hit = time <= limit[owner]
            unit, owner, time, dart = unit[hit], owner[hit], time[hit], dart[hit]
            darts.append((owner, time, mixed(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
        owner, time, dart = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.argsort(-time, kind="stable")
        place = owner * k + ((dart >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
        table = np.zeros(n * k, np.uint64)
        table[place[order]] = dart[order] | np.uint64(1)
        table = table.reshape(n, k)
        full = todo[(table[todo] != 0).all(axis=1)]
        out[full] = table[full]
        todo = todo[(table[todo] == 0).any(axis=1)]
        reach *= 2
    return out


def _band_keys(table: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(table), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(table), band + 1, np.uint64)
        for row in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + table[:, band * ROWS + row])
        keys[:, band] = key
    return keys


_SIGNED = "doc long, c1 long, c2 long, weight long, bands array<long>"


def _set_keys(cells: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Two numbers that stand for each weighted set."""
    sums = np.zeros((2, n), np.uint64)
    np.add.at(sums[0], of, cells)
    np.add.at(sums[1], of, mixed(cells ^ np.uint64(0x5DEECE66D)))
    return sums


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, two numbers that stand for its weighted set, the weight, and the band keys."""
    for batch in batches:
        docs, texts = batch.column("doc"), [t or "" for t in batch.column("text").to_pylist()]
        for begin, end in chunks_by_size(map(len, texts), _CHUNK):
            own = texts[begin:end]
            cells, of = units(*shingles(own))
            weight = np.bincount(of, minlength=len(own))
            sums = _set_keys(cells, of, len(own))
            keys = _band_keys(signatures(cells, of, len(own))).astype(np.int64)
            yield pa.record_batch(
                [
                    docs.slice(begin, end - begin),
                    pa.array(sums[0].astype(np.int64), mask=weight == 0),
                    pa.array(sums[1].astype(np.int64), mask=weight == 0),
                    pa.array(weight, pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
                ],
                names=["doc", "c1", "c2", "weight", "bands"],
            )


def _detail(wanted: np.ndarray):
    """The units of weight, in order, of texts that may be candidates."""

    def detail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in chunks_by_size(map(len, texts), _CHUNK):
                own = texts[begin:end]
                cells, of = units(*shingles(own))
                sums = _set_keys(cells, of, len(own))
                weight = np.bincount(of, minlength=len(own))
                keep = in_bitmap(wanted, sums[0]) & (weight > 0)
                cells = cells[np.lexsort((cells, of))][np.repeat(keep, weight)]
                yield pa.record_batch(
                    [pa.array(s[keep].astype(np.int64)) for s in sums] + detail_arrays(cells, weight[keep]),
                    names=["c1", "c2", "weight", "parity", "cells"],
                )

    return detail


def document_id(key: str, text: str) -> Column:
    """The id, or where it is null a negative number that stands for the text."""
    made = -(F.shiftrightunsigned(F.xxhash64(F.lit("no id"), text), 2)) - 1
    return F.coalesce(F.col(key).cast("long"), made)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, class_id and class_size of every row."""
    share = Fraction(threshold).limit_denominator(10_000).as_integer_ratio()
    named = docs.select(F.col(key).alias("key"), document_id(key, text).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = named.select("doc", "text")
    # c1 and c2 are null for documents without words, which stay alone
    signed = materialize(rows.mapInArrow(tidy_batches(_sign), _SIGNED))
    # a node is a weighted set; an id may have several
    sets = signed.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.max("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = materialize(sets.select("*", F.monotonically_increasing_id().alias("node")))
    banded = nodes.select("node", "weight", F.explode("bands").alias("key"))
    keyed = with_sizes(banded)
    candidates = materialize(nodes.select("c1", "c2", "node").join(keyed.select("node").distinct(), "node", "left_semi"))
    found = rows.select("text").mapInArrow(tidy_batches(_detail(bitmap_of(candidates, "c1"))), f"c1 long, c2 long, {DETAILS}")
    details = materialize(found.dropDuplicates(["c1", "c2"]).join(candidates, ["c1", "c2"]).drop("c1", "c2"))
    final = linked(keyed, details, share)
    classes = materialize(
        nodes.select("c1", "c2", "node").join(final, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("root"))
    )
    rooted = materialize(signed.select("doc", "c1", "c2").join(classes, ["c1", "c2"], "left").groupBy("doc", "root").agg(F.count("*").alias("n")))
    by_doc = materialize(rooted.groupBy("doc").agg(F.min("root").alias("root"), F.max("root").alias("last"), F.sum("n").alias("n")))
    # the texts of an id are versions of one document and join their classes
    several = by_doc.where("last > root").select("doc", F.col("root").alias("v"))
    if not several.isEmpty():
        links = materialize(rooted.join(several, "doc").where("root > v").select(F.col("root").alias("u"), "v").distinct())
        joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("least"))
        by_doc = materialize(by_doc.join(joined, "root", "left").select("doc", F.coalesce("least", "root").alias("root"), "n"))
    told = by_doc.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("n").alias("class_size"))
    alone = by_doc.where("root IS NULL").select("doc", F.col("doc").alias("class_id"), F.col("n").alias("class_size"))
    every = by_doc.join(materialize(told), "root").select("doc", "class_id", "class_size").union(alone)
    return named.select("key", "doc").join(every, "doc").select(F.col("key").alias(key), "class_id", "class_size")
