"""N-gram Jaccard join (operator 13) with token-combination prefixes.

A document is the set of its shingles of four words. In one order of all tokens, rare ones first, two sets that
reach the threshold t have their first l common tokens in prefixes of |x| - ceil(t |x|) + l tokens. Tokens are in
classes by their frequency. Rare tokens are indexed one by one; of the more frequent ones, combinations of two, and of
the most frequent ones, of three. With l = 1 + the sum over the classes in the prefix of min(tokens, k - 1), a common
combination of k tokens of one class cannot be missed. To keep the combinations of a long text few, its frequent
tokens are dealt by hash into sub-classes of about ``PER_GROUP`` prefix tokens, which are classes of their own. How many
there are follows from the power of two in the set's size; a set that may have partners in the next lower one is
indexed by that one's rule as well.

Frequencies only choose order and classes, so any count of them gives the same links. They are counted over all
documents as sorted streams of truncated hashes, shuffled as differences of 16 bits. The most frequent ``FREQUENT``
tokens at most go to the tasks, and a bitmap of bounded size of all that two sets or more hold: what is not in it comes
first in the order, is in one set only and makes no keys, so a set with many tokens of its own has none. Equal sets are one node from the start. Sets that share a key are verified exactly;
see ``linking`` for common keys. Only the keys, not the sets, are shuffled for all documents.

Words stand as 64-bit numbers and shingles as numbers made of those; equal sets are recognised by 128 bits.

Defined results: null texts and texts without words have the empty set, which is linked with nothing; a text of fewer
than four words is one shingle; repeated rows share a component; rows that share an id are documents of their own, and
``component_id`` is the smallest id that is not null, or null if there is none; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm.bitmaps import bitmap_of, in_bitmap
from assaylane.llm.common import mixed, parts_for, tidy, tidy_batches, total_bytes
from assaylane.llm.linking import DETAILS, detail_arrays, linked, with_sizes
from assaylane.llm.words import NOT_SPACE, find_words, run_numbers, text_chunks, word_numbers
from assaylane.session import materialize

SHINGLE, SHARE = 4, (85, 100)
FREQUENT = 1 << 21  # tokens that are known to be frequent; 32 MB with their counts
SHARED_BITS = 28  # the bitmap of tokens that several sets hold has 2^28 bits at most; 32 MB
RARE, COMMON = 32, 1_024  # from so many sets on, a token is indexed in pairs, or in threes
PER_GROUP = 4  # fewer make prefixes longer, more make more combinations
COUNT_CHUNK = 32 << 20  # bytes of text of one sorted stream
COUNT_PART = 128 << 20  # bytes of text whose tokens are counted in one task
_ESCAPE = np.uint16(0xFFFF)
_SECOND = np.uint64(0x5DEECE66D)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, one text after the other, and their counts."""
    words = find_words(texts, NOT_SPACE)
    numbers, counts = word_numbers(words), words.counts
    ends = np.repeat(words.first[1:], counts)
    full = run_numbers(numbers, size)
    whole = np.arange(len(full)) + size <= ends[: len(full)]
    token, owner = [full[whole]], [words.owner[: len(full)][whole]]
    for n in range(1, size):  # texts of fewer words
        short = np.flatnonzero(counts == n)
        token.append(run_numbers(numbers, n)[words.first[short]] if len(short) else np.zeros(0, np.uint64))
        owner.append(short)
    token, owner = np.concatenate(token), np.concatenate(owner)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[new], np.bincount(owner[new], minlength=len(texts))


def _of_texts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each set."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def set_keys(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    return _of_texts(mixed(tokens), sizes), _of_texts(mixed(tokens ^ _SECOND), sizes)


# --- frequencies


def packed_differences(ids: np.ndarray, begin: int) -> bytes:
    """Ascending numbers as 16-bit differences; 65535 means to go on by so much without a number."""
    gaps = np.diff(ids, prepend=np.int64(begin))
    skips, rest = np.divmod(gaps, int(_ESCAPE))
    out = np.full(int(skips.sum()) + len(ids), _ESCAPE, np.uint16)
    out[np.cumsum(skips + 1) - 1] = rest
    return out.tobytes()


def unpacked_differences(data: bytes, begin: int) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return begin + np.cumsum(gaps, dtype=np.int64)[gaps != _ESCAPE]


def merged_differences(streams: Sequence[bytes | pa.Buffer], begin: int) -> np.ndarray:
    """The numbers of several streams in ascending order, in one array that is filled and sorted in place."""
    sizes = [int(np.count_nonzero(np.frombuffer(s, np.uint16) != _ESCAPE)) for s in streams]
    out, at = np.empty(sum(sizes), np.int64), 0
    for stream, size in zip(streams, sizes, strict=True):
        out[at : at + size] = unpacked_differences(stream, begin)
        at += size
    out.sort()
    return out


def repeated(ids: np.ndarray, least: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that an ascending array has ``least`` times or more, and how often; found block by block, as most
    tokens come once."""
    numbers, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(ids):
        end = int(np.searchsorted(ids, ids[min(at + block, len(ids)) - 1], "right"))  # the last run is whole
        own = ids[at:end]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(first, len(own)))
        numbers.append(own[first][n >= least])
        counts.append(n[n >= least])
        at = end
    return np.concatenate(numbers), np.concatenate(counts)


def _streams(bits: int, parts: int):
    """Per chunk and part of the number range: the sorted truncated tokens of distinct sets."""
    edges = [(i << bits) // parts for i in range(parts + 1)]

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            ids >>= np.uint64(64 - bits)
            ids.sort()
            ids = ids.view(np.int64)  # at most 60 bits
            cuts = np.searchsorted(ids, edges)
            own = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
            blobs = [packed_differences(ids[cuts[i] : cuts[i + 1]], edges[i]) for i in own]
            return pa.record_batch([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "ids"])

        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                tokens, sizes = shingle_sets(chunk.column("text"))
                once = first_of(set_keys(tokens, sizes)[0], seen)
                held.append(tokens[np.repeat(once, sizes)])
                size += chunk.nbytes
                if size >= COUNT_CHUNK:
                    yield flush()
                    size = 0
        yield flush()

    return streams


def first_of(keys: np.ndarray, seen: set, most: int = 1 << 19) -> np.ndarray:
    """Which sets are new to this task, so that copies are handled once; the memory for it is bounded."""
    if len(seen) > most:
        seen.clear()
    out = np.zeros(len(keys), bool)
    for i, k in enumerate(keys.tolist()):
        if k not in seen:
            seen.add(k)
            out[i] = True
    return out


def _frequent(bits: int, parts: int, rare: int, shared_bits: int):
    """Per part: the frequent numbers and their counts, and a bitmap of the numbers that two sets or more hold, by
    their first ``shared_bits`` bits, from byte ``at`` on."""

    def frequent(key: tuple, table: pa.Table) -> pa.Table:
        begin = (key[0].as_py() << bits) // parts
        ids = merged_differences([b.as_buffer() for b in table.column("ids")], begin)
        numbers, n = repeated(ids, min(rare, 2))
        del ids
        shared = numbers[n >= 2] >> (bits - shared_bits)
        at = int(shared[0]) >> 3 if len(shared) else 0
        marks = np.zeros(((int(shared[-1]) >> 3) - at + 1) * 8 if len(shared) else 0, np.uint8)
        marks[shared - 8 * at] = 1
        keep = n >= rare
        return pa.table(
            {
                "at": pa.array([at], pa.int64()),
                "shared": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()),
                "ids": pa.array([numbers[keep]], pa.list_(pa.int64())),
                "counts": pa.array([n[keep].astype(np.int64)], pa.list_(pa.int64())),
            }
        )

    return frequent


@dataclass
class Frequencies:
    """Tokens cut to their first ``bits`` bits: the most frequent ones and their counts, and a bitmap, by the first
    ``shared_bits`` bits, of all that two sets or more hold. A token that is not in the bitmap is in one set only."""

    bits: int
    ids: np.ndarray
    counts: np.ndarray
    shared_bits: int
    shared: np.ndarray

    def is_shared(self, tokens: np.ndarray) -> np.ndarray:
        slot = (tokens >> np.uint64(64 - self.shared_bits)).astype(np.int64)
        return (self.shared[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    def found(self, tokens: np.ndarray) -> np.ndarray:
        """1 + the place of each token among the frequent ones, 0 for the others."""
        if not len(self.ids):
            return np.zeros(len(tokens), np.int64)
        cut = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids, cut), len(self.ids) - 1)
        return np.where(self.ids[at] == cut, at + 1, 0)


def token_frequencies(docs: DataFrame, size: int, rare: int = RARE, most: int = FREQUENT, part_bytes: int = COUNT_PART) -> Frequencies:
    """Frequencies of the tokens of all texts, of ``size`` bytes together.

    At most ``most`` tokens that ``rare`` sets or more hold, the most frequent ones, and a bitmap of ``SHARED_BITS``
    bits at most go to the driver and the tasks. Copies of a set count once for each task that meets them.
    """
    parts = parts_for(size, part_bytes)
    bits = min(max(24, size.bit_length() + 6), 60)
    shared_bits = min(bits, max(20, size.bit_length() - 1), SHARED_BITS)
    blobs = docs.select("text").mapInArrow(tidy_batches(_streams(bits, parts)), "part int, ids binary")
    schema = "at long, shared binary, ids array<long>, counts array<long>"
    counted = materialize(blobs.groupBy("part").applyInArrow(tidy(_frequent(bits, parts, rare, shared_bits)), schema))
    shared = np.zeros((1 << shared_bits) // 8, np.uint8)
    for row in counted.select("at", "shared").toLocalIterator():
        piece = np.frombuffer(row["shared"], np.uint8)
        shared[row["at"] : row["at"] + len(piece)] |= piece
    each = counted.select(F.explode(F.arrays_zip("ids", "counts")).alias("t")).select(F.col("t.ids").alias("id"), F.col("t.counts").alias("n"))
    # the most frequent ones: how many there are of each power of two tells where to cut
    levels = each.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for level, n in sorted(levels, reverse=True):
        if total + n > most:
            break
        total, least = total + n, level
    if least is None:
        none = np.zeros(0, np.int64)
        return Frequencies(bits, none, none, shared_bits, shared)
    table = each.where(F.floor(F.log2("n")) >= least).orderBy("id").toArrow()
    return Frequencies(bits, table.column("id").to_numpy(), table.column("n").to_numpy(), shared_bits, shared)


# --- keys


def _least_common(size: int, share: tuple[int, int]) -> int:
    """Tokens that a set of the size has in common at least with any similar set."""
    return -(-size * share[0] // share[1])


def _groups(level: int, share: tuple[int, int]) -> int:
    """Sub-classes of a frequency class, for sets of 2^level tokens and more; 0: all tokens are indexed one by one."""
    prefix = ceil(1.5 * (1 << level) * (share[1] - share[0]) / share[1])
    groups = max(1, round(prefix / PER_GROUP))
    return groups if _least_common(1 << level, share) >= 1 + 3 * groups else 0


def prefix_keys(tokens: np.ndarray, classes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Keys of a set: ``tokens`` in the global order, ``classes`` of each: 0 for those that no other set has, which
    make no keys, 1 for the rare ones, 2 and 3 for those that are combined."""
    n = len(tokens)
    spare = n - _least_common(n, share)
    first = classes[: spare + 1]
    if (first <= 1).all():
        return tokens[: spare + 1][first == 1]
    level = n.bit_length() - 1
    levels = [level]
    if level and _least_common(n, share) < 1 << level:
        levels.append(level - 1)
    alone, out = np.zeros(n, bool), []
    for lv in levels:
        groups = _groups(lv, share)
        if not groups:
            alone[: spare + 1] |= first > 0
            continue
        group = np.where(classes > 1, (tokens >> np.uint64(7)) % np.uint64(groups), 0).astype(np.int64)
        kind = np.where(classes > 1, 2 * group + classes - 1, 0)
        need = 1
        while True:
            reach = min(spare + need, n)
            held = np.bincount(kind[:reach], minlength=2 * groups + 1)[1:]
            # odd places hold class 2 with pairs, even ones class 3 with threes
            now = 1 + int(np.minimum(held[0::2], 1).sum() + np.minimum(held[1::2], 2).sum())
            if now <= need:
                break
            need = now
        alone[:reach] |= classes[:reach] == 1
        mark = np.uint64(lv + 1) * _SECOND
        for k in np.flatnonzero(held) + 1:
            own = mixed(tokens[:reach][kind[:reach] == k] ^ mark)
            size = 2 if k % 2 else 3
            if len(own) >= size:
                out.append(_combined(own, size))
    return np.unique(np.concatenate([tokens[alone], *out]))


def _combined(tokens: np.ndarray, size: int) -> np.ndarray:
    """A number for each combination of ``size`` tokens, whatever their order."""
    at = np.array(list(combinations(range(len(tokens)), size)), np.int64)
    return mixed(mixed(tokens)[at].sum(axis=1, dtype=np.uint64) + np.uint64(size))


_SIGNED = "doc long, n long, c1 long, c2 long, keys array<long>"


def _sign(known: Frequencies, common: int, share: tuple[int, int]):
    """Per text: the size and the key of its set, and the keys of its prefix."""
    kinds = np.where(known.counts >= common, 3, 2).astype(np.int8)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                tokens, sizes = shingle_sets(chunk.column("text"))
                c1, c2 = set_keys(tokens, sizes)
                new = first_of(c1, seen)
                shared = known.is_shared(tokens)
                begins = np.cumsum(sizes) - sizes
                of = np.repeat(np.arange(len(sizes)), sizes)
                # tokens of one set come first in the order and no other set has them: the prefix holds the others
                # only if there are too few of those
                single = sizes - np.bincount(of[shared], minlength=len(sizes))
                keys, lengths = [np.zeros(0, np.uint64)], []
                for i, (size, begin) in enumerate(zip(sizes.tolist(), begins.tolist(), strict=True)):
                    need = size - _least_common(size, share) + 1 if size else 0
                    if not new[i] or single[i] >= need:
                        lengths.append(0)
                        continue
                    own, mark = tokens[begin : begin + size], shared[begin : begin + size]
                    hit = known.found(own)
                    rank, kind = np.where(mark, 1, 0), np.where(mark, 1, 0).astype(np.int8)
                    if hit.any():
                        rank = np.where(mark & (hit > 0), known.counts[hit - 1], rank)
                        kind = np.where(mark & (hit > 0), kinds[hit - 1], kind)
                    order = np.lexsort((own, rank))
                    mine = prefix_keys(own[order], kind[order], share)
                    keys.append(mine)
                    lengths.append(len(mine))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                has = sizes > 0
                yield pa.record_batch(
                    [
                        chunk.column("doc"),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(c1.astype(np.int64), mask=~has),
                        pa.array(c2.astype(np.int64), mask=~has),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).astype(np.int64))),
                    ],
                    names=["doc", "n", "c1", "c2", "keys"],
                )

    return sign


def _detail(wanted: np.ndarray):
    """The sets of texts that may be candidates."""

    def detail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                tokens, sizes = shingle_sets(chunk.column("text"))
                c1, c2 = set_keys(tokens, sizes)
                keep = in_bitmap(wanted, c1) & (sizes > 0)
                keep[keep] = first_of(c1[keep], seen)
                own = tokens[np.repeat(keep, sizes)]
                yield pa.record_batch(
                    [pa.array(c1[keep].astype(np.int64)), pa.array(c2[keep].astype(np.int64)), *detail_arrays(own, sizes[keep])],
                    names=["c1", "c2", "weight", "parity", "cells"],
                )

    return detail


def ngram_join(
    docs: DataFrame, share: tuple[int, int] = SHARE, text: str = "text", key: str = "doc_id",
    rare: int = RARE, common: int = COMMON, most: int = FREQUENT, part_bytes: int = COUNT_PART, **limits: int,
) -> DataFrame:
    """``key``, n_shingles and component_id of every row. ``share``: the least similarity as a fraction."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    known = token_frequencies(rows, total_bytes(rows, "text"), rare, most, part_bytes)
    signed = materialize(rows.mapInArrow(tidy_batches(_sign(known, common, share)), _SIGNED))
    sets = signed.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.max("n").alias("weight"), F.max("keys").alias("keys"))
    nodes = materialize(sets.select("c1", "c2", "weight", "keys", F.monotonically_increasing_id().alias("node")))
    every = nodes.select("node", "weight", F.explode("keys").alias("key"))
    keyed = with_sizes(every)
    candidates = materialize(nodes.select("c1", "c2", "node").join(keyed.select("node").distinct(), "node", "left_semi"))
    found = rows.mapInArrow(tidy_batches(_detail(bitmap_of(candidates, "c1"))), f"c1 long, c2 long, {DETAILS}")
    details = materialize(found.dropDuplicates(["c1", "c2"]).join(candidates, ["c1", "c2"]).drop("c1", "c2"))
    roots = linked(keyed, details, share, **limits)
    rooted = nodes.select("c1", "c2", "node").join(roots, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("root"))
    placed = materialize(signed.select("doc", "n", "c1", "c2").join(rooted, ["c1", "c2"], "left").select("doc", "n", "root"))
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("component_id"))
    of_sets = placed.join(least, "root").select("doc", "n", "component_id")
    alone = placed.where("root IS NULL").select("doc", "n", F.col("doc").alias("component_id"))
    return of_sets.union(alone).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def brute_force(rows: list[tuple[int | None, str | None]], share: tuple[int, int] = SHARE) -> list[tuple]:
    """What must come out, pair by pair; for tests."""
    import re

    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = max(len(words) - SHINGLE + 1, 1 if words else 0)
        sets.append({tuple(words[i : i + SHINGLE]) for i in range(n)})
    by_token: dict[tuple, list[int]] = {}
    top = list(range(len(rows)))

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for token in s:
            for j in by_token.get(token, ()):
                common[j] = common.get(j, 0) + 1
            by_token.setdefault(token, []).append(i)
        for j, n in common.items():
            if share[1] * n >= share[0] * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    ids: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(ids.get(root(i), doc), doc)
    return [(doc, len(sets[i]), ids.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
