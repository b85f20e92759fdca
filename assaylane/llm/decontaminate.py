"""Benchmark decontamination (operator 3).

One Aho-Corasick automaton holds all windows of the benchmark: ten consecutive words, or all words of
a shorter item. A text is normalised to its words between blanks, scanned once, and every match is
taken back to words and to character offsets of the original text. The automaton is built once in
each worker from the windows; a benchmark of more than ``AUTOMATON_BYTES`` of windows is cut into
several automata, which scan one after the other, so that what is sent to the tasks stays bounded.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. As every byte of a
character beyond ASCII is above 0x7F, this works on UTF-8 bytes.

Defined results: null texts and texts without words have no hits; a null item has no windows, and an
item with a null id hits words but is not listed; repeated rows each get a result, repeated items
count once by their id; other columns are ignored; empty tables give no hits or an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assaylane.llm.common import tidy_batches, total_bytes, worker_cache
from assaylane.llm.words import text_chunks

WINDOW = 10
AUTOMATON_BYTES = 64 << 20  # of windows in one automaton
ITEM_BYTES = 1 << 20  # benchmark text read at a time

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def windows_of(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def item_windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """One row per distinct window: the window and the ids of its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = windows_of(value, size)
                ids += [key] * len(own)
                windows += own
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], names=["item", "window"])

    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(cut, "item string, window binary").groupBy("window").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _automaton(windows: list[tuple[bytes, list[str]]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for window, items in windows:
        machine.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window), items))
    machine.make_automaton()
    return machine


def _shards(spark, windows: DataFrame, most: int) -> list[Broadcast]:
    """The windows in broadcasts of bounded size; no more than one part is held here at a time."""
    shards, held, size = [], [], 0
    for row in windows.orderBy("window").toLocalIterator():
        held.append((bytes(row["window"]), [i for i in row["items"]]))
        size += len(row["window"]) + 16
        if size >= most:
            shards.append(spark.sparkContext.broadcast((uuid.uuid4().hex, held)))
            held, size = [], 0
    if held or not shards:
        shards.append(spark.sparkContext.broadcast((uuid.uuid4().hex, held)))
    return shards


def _spans(text: str, starts: np.ndarray, sizes: list[int], hit: np.ndarray) -> list[int]:
    """Character offsets (begin, end, begin, end, ...) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    raw, out = text.encode(), []
    for first, last in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True):
        a, b = int(starts[first]), int(starts[last]) + sizes[last]
        begin = len(raw[:a].decode()) if not out else out[-1] + len(raw[at:a].decode())
        out += [begin, begin + len(raw[a:b].decode())]
        at = b
    return out


def _word_starts(text: str) -> np.ndarray:
    """Byte offset of each word in the original text."""
    plain = np.frombuffer(text.encode().translate(_WORD_BYTES), np.uint8) != 32
    return np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))


def _scan(shard: Broadcast, schema: pa.Schema):
    """Adds to the words hit and the items found so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, windows = shard.value
        machine = worker_cache(("automaton", name), lambda: _automaton(windows), large="automaton")
        for batch in (piece for whole in batches for piece in text_chunks(whole, "text")):
            texts = batch.column("text").to_pylist()
            n_words, runs, items = [], batch.column("runs").to_pylist(), batch.column("items").to_pylist()
            for i, text in enumerate(texts):
                words = words_of(text)
                n_words.append(len(words))
                if not words or not len(machine):
                    continue
                line = f" {b' '.join(words).decode('latin-1')} "
                found = list(machine.iter(line))
                if not found:
                    continue
                blanks = np.cumsum([0, *(len(w) + 1 for w in words)])  # where the blank before each word is
                new, ids = list(runs[i]), set(items[i])
                ends = np.searchsorted(blanks, [end for end, _ in found]).tolist()
                for last, (_, (size, _, own)) in zip(ends, found, strict=True):
                    ids.update(own)
                    if new and last - size <= new[-1] and last - size >= new[-2]:
                        new[-1] = max(new[-1], last)
                    else:
                        new += [last - size, last]
                runs[i], items[i] = new, sorted(ids)
            columns = {
                "n_words": pa.array(n_words, pa.int64()),
                "runs": pa.array(runs, pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(
                [columns.get(f.name, None) if f.name in columns else batch.column(f.name).cast(f.type) for f in schema],
                schema=schema,
            )

    return scan


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of word numbers -> hit words, and spans of the original text."""
    for batch in batches:
        n_hit, spans = [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "n_words", "runs"))
        for text, n, runs in zip(*columns, strict=True):
            if not runs:
                n_hit.append(0)
                spans.append([])
                continue
            hit = np.zeros(n, bool)
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                hit[a:b] = True
            n_hit.append(int(hit.sum()))
            spans.append(_spans(text, _word_starts(text), [len(w) for w in words_of(text)], hit))
        names = [n for n in batch.schema.names if n != "runs"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int32()))],
            names=[*names, "n_hit", "spans"],
        )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Per row of ``docs``: the kept columns, ``text``, n_words, n_hit, ``items`` (ids found, sorted) and
    ``spans``, character offsets (begin, end, begin, end, ...) of the runs of hit words."""
    spark = docs.sparkSession
    # a kept column that is the text itself goes to the tasks once
    plain = docs.select(F.col(text)).schema[0].dataType == T.StringType()
    names = ["text" if plain and c == text else f"kept{i}" for i, c in enumerate(keep)]
    named = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True) if n != "text"],
        F.col(text).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("runs"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = to_arrow_schema(named.schema)
    scanned = named
    *others, last = _shards(spark, item_windows(items, size, item_id, item_text), automaton_bytes)
    for shard in others:
        scanned = scanned.mapInArrow(tidy_batches(_scan(shard, schema)), named.schema)
    scan = _scan(last, schema)
    located = scanned.mapInArrow(  # one worker for both steps, as two would hold every batch twice
        tidy_batches(lambda batches: _locate(scan(batches))),
        named.drop("runs").withColumns({"n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<int>")}).schema,
    )
    return located.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        *[F.col(c).alias(c) for c in ("text", "n_words", "n_hit", "items", "spans") if c not in keep],
    )


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest_of(text: str | None, items: list[tuple[object, str | None]]) -> tuple[int, int, int, str, bool]:
    """What ``digests`` must give for one text, window by window; for tests."""
    words, hit, found = words_of(text), set(), set()
    for key, value in items:
        for window in windows_of(value):
            parts = window.split()
            for i in range(len(words) - len(parts) + 1):
                if words[i : i + len(parts)] == parts:
                    hit.update(range(i, i + len(parts)))
                    if key is not None:
                        found.add(str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
