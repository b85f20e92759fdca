"""Token ids in packed binary rows (operator 7): best-fit-decreasing with a segment tree of capacities.

Texts are encoded in batches and cut into pieces of at most ``length`` ids; nothing is lost, as the
pieces of a text keep their number. Full pieces and rests are dealt into shards of bounded size by
the hash of document and piece, so that no document, source or group of copies gathers in one task.
In a shard the pieces go, longest first, into the row with the least room that still holds them. Rows
with the same room are alike, so the tree is over room sizes and not over rows: it finds the smallest
room of at least the wanted size in log(length) steps.

A row is a matrix line of ``length`` ids (little-endian, 16 bits where the vocabulary allows, else
32; the rest is padding), the cumulative lengths of its segments, position ids that restart at every
segment, and for every segment its document and piece number. ``write_matrices`` stores the lines as
files of raw binary.

Defined results: null and empty texts have no ids and are in no row; repeated rows are packed each;
a null document id is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm import bpe, pretokens
from assaylane.llm.common import chunks_by_size, parts_for, ragged_index, total_bytes, worker_cache

LENGTH = 2_048
SHARD_BYTES = 24 << 20  # bytes of text for each packing shard
CHUNK_CHARS = 1 << 17  # characters that are encoded at a time
KNOWN_WORDS = 1 << 19  # words a worker remembers, and their characters
KNOWN_CHARS = 1 << 23


class Rooms:
    """Open rows by their room: a segment tree over 0..length that tells which rooms are taken."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.any = [0] * (2 * self.size)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, wanted: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``wanted``, removed; and its room."""
        node = wanted + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.any[node] -= 1
            node >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], length: int) -> list[int]:
    """The row of every piece; pieces come longest first."""
    rooms, placed, n = Rooms(length), [], 0
    for size in lengths:
        if size == length:
            row, room = n, length
            n += 1
        else:
            found = rooms.take(size)
            if found is None:
                row, room = n, length
                n += 1
            else:
                row, room = found
        if room > size:
            rooms.add(room - size, row)
        placed.append(row)
    return placed


class KnownWords:
    """Words and their ids in flat arrays: an open hash table of word numbers, all words of a batch looked up at once.

    The characters are kept, too, as a word is compared and not only its hash.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)  # word numbers; half of the slots at least are free
        self.n = 0
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.points, self.ids = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.uint32)
        self.point_ends, self.id_ends = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # they begin with 0

    def full(self) -> bool:
        return self.n > KNOWN_WORDS or self.point_ends[self.n] > KNOWN_CHARS

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for a new one."""
        last = np.uint64(len(self.slots) - 1)
        slot = hashes & last
        found = self.slots[slot]
        other = np.flatnonzero((found >= 0) & (self.hashes[found] != hashes))
        while len(other):
            slot[other] = (slot[other] + np.uint64(1)) & last
            found[other] = self.slots[slot[other]]
            other = other[(found[other] >= 0) & (self.hashes[found[other]] != hashes[other])]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        last = np.uint64(len(self.slots) - 1)
        slot = self.hashes[numbers] & last
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers  # taken, or given to another one of these words
            numbers, slot = numbers[left], (slot[left] + np.uint64(1)) & last

    def add(self, hashes: np.ndarray, points: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New words with hashes that differ: their characters and their ids end to end, and how many each has."""
        n, more = self.n, self.n + len(hashes)
        chars, tokens = self.point_ends[n], self.id_ends[n]
        self.hashes = _with(self.hashes, n, hashes)
        self.points = _with(self.points, chars, points)
        self.ids = _with(self.ids, tokens, ids)
        self.point_ends = _with(self.point_ends, n + 1, chars + np.cumsum(lengths))
        self.id_ends = _with(self.id_ends, n + 1, tokens + np.cumsum(counts))
        self.n = more
        if 2 * more > len(self.slots):
            self.slots = np.full(1 << (2 * more).bit_length(), -1, np.int32)
            self._place(np.arange(more, dtype=np.int32))
        else:
            self._place(np.arange(n, more, dtype=np.int32))

    def holds(self, numbers: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> bool:
        """Whether these are the words of the numbers, character by character."""
        starts = self.point_ends[numbers]
        return np.array_equal(self.point_ends[numbers + 1] - starts, lengths) and np.array_equal(
            self.points[ragged_index(starts, lengths)], points
        )

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        starts = self.id_ends[numbers]
        counts = self.id_ends[numbers + 1] - starts
        return self.ids[ragged_index(starts, counts)], counts


def _with(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``held`` with ``values`` from ``at`` on, in a larger array where they do not fit."""
    if at + len(values) > len(held):
        larger = np.zeros(max(at + len(values), len(held) * 3 // 2), held.dtype)
        larger[:at] = held[:at]
        held = larger
    held[at : at + len(values)] = values
    return held


def _encode_batch(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text starts."""
    split = pretokens.split(texts)
    hashes, lengths = split.hashes(), np.diff(split.starts)
    points = np.frombuffer(split.text.encode("utf-32-le"), np.uint32)
    known: KnownWords = worker_cache(("ids of words", path), KnownWords, large="bpe")
    if known.full():
        known.clear()
    numbers = known.find(hashes)
    new = np.flatnonzero(numbers < 0)
    if len(new):
        unique, where = np.unique(hashes[new], return_index=True)
        where = new[where]
        encode, text = bpe.encoder(path)._encode_single_piece, split.text
        starts = split.starts[where]
        found = [encode(text[a:b]) for a, b in zip(starts.tolist(), split.starts[where + 1].tolist(), strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        known.add(unique, points[ragged_index(starts, lengths[where])], lengths[where], ids, counts)
        numbers[new] = known.find(hashes[new])
    if not known.holds(numbers, points, lengths):  # words that differ have one hash
        own = [np.array(bpe.encoder(path).encode_ordinary(t), np.uint32) for t in texts]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(i) for i in own])])
    ids, counts = known.ids_of(numbers)
    return ids, np.concatenate([[0], np.cumsum(counts)])[split.first]


def _pieces(path: str, length: int, kind: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc").to_pylist()
            for begin, end in chunks_by_size(map(len, texts), CHUNK_CHARS):
                ids, first = _encode_batch(path, texts[begin:end])
                ids = ids.astype(kind)
                docs, numbers, values = [], [], []
                for i in range(begin, end):
                    a, b = int(first[i - begin]), int(first[i - begin + 1])
                    for n, at in enumerate(range(a, b, length)):
                        docs.append(keys[i])
                        numbers.append(n)
                        values.append(ids[at : min(at + length, b)].tobytes())
                yield pa.record_batch(
                    [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(values, pa.binary())],
                    names=["doc", "piece", "ids"],
                )

    return pieces


def _pack(length: int, width: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc", "ascending"), ("piece", "ascending")])
        sizes = table.column("size").to_pylist()
        rows = np.array(best_fit_decreasing(sizes, length), np.int64)
        order = np.argsort(rows, kind="stable")
        bounds = np.searchsorted(rows[order], np.arange(rows.max() + 2 if len(rows) else 1)).tolist()
        docs, numbers, ids = (table.column(c).take(pa.array(order)) for c in ("doc", "piece", "ids"))
        docs, numbers, ids = docs.to_pylist(), numbers.to_pylist(), ids.to_pylist()
        sizes = np.array(sizes, np.int64)[order]
        out: dict[str, list] = {n: [] for n in ("ids", "cu_seqlens", "position_ids", "docs", "pieces")}
        for a, b in zip(bounds, bounds[1:], strict=False):
            out["ids"].append(b"".join(ids[a:b]).ljust(length * width, b"\0"))
            ends = np.concatenate([[0], np.cumsum(sizes[a:b])])
            out["cu_seqlens"].append(ends.astype(np.int32))
            lengths = np.append(sizes[a:b], length - ends[-1])
            out["position_ids"].append(ragged_index(np.zeros(b - a + 1, np.int64), lengths).astype("<u2" if length <= 1 << 16 else "<u4").tobytes())
            out["docs"].append(docs[a:b])
            out["pieces"].append(numbers[a:b])
        n = len(out["ids"])
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * n, pa.int64()),
                "line": pa.array(range(n), pa.int32()),
                "ids": pa.array(out["ids"], pa.binary()),
                "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                "position_ids": pa.array(out["position_ids"], pa.binary()),
                "doc_ids": pa.array(out["docs"], pa.list_(pa.int64())),
                "pieces": pa.array(out["pieces"], pa.list_(pa.int32())),
            }
        )

    return pack


def pack_tokens(
    docs: DataFrame, path: str, vocabulary: int, length: int = LENGTH, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Packed rows: shard, line, ids, cu_seqlens, position_ids, doc_ids, pieces."""
    kind, width = ("<u2", 2) if vocabulary <= 1 << 16 else ("<u4", 4)
    shards = parts_for(total_bytes(docs, text), SHARD_BYTES)
    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    pieces = named.mapInArrow(_pieces(path, length, kind), "doc long, piece int, ids binary").select(
        F.pmod(F.xxhash64("doc", "piece", F.substring("ids", 1, 64)), F.lit(shards)).cast("long").alias("shard"),
        (F.octet_length("ids") / width).cast("int").alias("size"),
        "doc",
        "piece",
        "ids",
    )
    return pieces.groupBy("shard").applyInArrow(
        _pack(length, width),
        "shard long, line int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>",
    )


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as a table whose ``ids`` are matrix lines, one folder per shard range; readers map the
    binary column as a (rows, length) array."""
    packed.write.mode("errorifexists").parquet(path)
