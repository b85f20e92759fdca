"""Phrase collocations (operator 11) from count streams in prefix and in suffix order.

Passes over the texts count words, then runs of two and of three words of which all parts are frequent, and at last
the phrases all of whose runs are. A phrase can only be frequent if its parts are, so each pass leaves out what the ones
before it rule out, by bitmaps of a fixed size; a chance hit in one costs a count and no more. Runs are counted in
sorted streams of their numbers, one for each chunk and range of numbers, which are shuffled as 32 bits and a count for
each number of a chunk and merged. Phrases that passed all of that go the same way, as sorted streams of words and
counts, each number of words on its own.

A phrase is a key: eight bytes for the language and for each word, so that byte order puts every phrase directly after
its beginnings. The stream of counts, with one row per language for all words, is laid out twice, in the order of the
words and in that of the reversed words, in ranges that are sorted on their own. A range gets the beginnings of its
first phrase as well. One walk along a range then finds, for every phrase, the last shorter row before it of each
length: the counts of its beginnings in prefix order, of its ends in suffix order; and for each phrase whether one
that is a word longer on that side has the same count. The two walks are merged on the phrase and give the scores. No
phrase is looked up in a table of the others.

Score: the lowest of floor(1000 a n / (l r)) over the cuts, in decimals of 38 digits. A phrase inside a longer one with
the same count is dropped; it is enough to look one word ahead, as counts fall from each phrase to the next longer one.

Words stand as 64-bit numbers until the end.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each; ties in score go to the
higher count and then to the phrase in byte order; languages without a phrase that is frequent enough do not show;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylane.llm.bitmaps import bitmap_of, in_bitmap
from assaylane.llm.bpe import pack, unpack
from assaylane.llm.common import mixed, parts_for, tidy, tidy_batches, total_bytes
from assaylane.llm.words import IN_PHRASE, PUNCTUATION, Words, find_words, run_numbers, text_chunks, word_numbers
from assaylane.session import materialize

LONGEST, LEAST, BEST = 5, 100, 2_000
UNKNOWN = "und"
CHUNK = 4 << 20  # bytes of text whose counts are added up at once
KNOWN_RUNS = 3  # runs of up to so many words are counted before phrases are
KEPT_BITS = 27  # the bitmap of frequent runs of a length; 16 MB
PART_BYTES = 48 << 20  # bytes of text whose runs are merged in one task
MERGED_ROWS = 1 << 18  # rows of phrases whose counts are added up at once
RANGE_ROWS = 500_000
SAMPLE_ROWS = 100  # for each range, to place its bounds
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNT_BITS, _COUNT = np.uint64(32), np.uint64((1 << 32) - 1)


def language_number(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed=11) or 1


def _pieces(words: Words) -> np.ndarray:
    """For every word, the end of its piece, as a number of words: no phrase passes punctuation or the end of a text."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.cumsum(PUNCTUATION[words.data], dtype=np.int32)
    last = np.ones(n, bool)
    last[:-1] = cut[words.starts[1:]] != cut[words.ends[:-1] - 1]
    last[words.first[1:][words.counts > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    return ends[np.searchsorted(ends, np.arange(n), side="right")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, Words, np.ndarray]]:
    """Languages, the language of each word, the words, their numbers; texts of several batches together."""
    held, size = [], 0

    def joined() -> Iterator[tuple]:
        table = pa.Table.from_batches(held).combine_chunks()
        for chunk in table.to_batches():
            names = chunk.column("lang").dictionary_encode()
            words = find_words(chunk.column("text"), IN_PHRASE)
            lang = np.repeat(names.indices.to_numpy(), words.counts)
            yield names.dictionary.to_pylist(), lang, words, word_numbers(words)

    for batch in batches:
        for part in text_chunks(batch, "text", CHUNK):
            if held and size + part.nbytes > CHUNK:
                yield from joined()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
        # what is left over is copied, so that it does not hold this batch while the next one is read
        held = [part.take(pa.array(np.arange(len(part)))) for part in held]
        batch = part = None
    if held:
        yield from joined()


def _with_language(numbers: np.ndarray, langs: list[str], lang: np.ndarray) -> np.ndarray:
    """Numbers that differ by language as well."""
    own = np.array([language_number(x) for x in langs], np.uint64)
    return mixed(numbers * _STEP + own[lang]) if len(numbers) else numbers


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, its number, count; the counts of a chunk added up."""
    for langs, lang, words, numbers in _chunks(batches):
        order = np.lexsort((numbers, lang))
        a, b = lang[order], numbers[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(a)))
        one = order[first]
        yield pa.record_batch(
            [
                pa.DictionaryArray.from_arrays(pa.array(a[first].astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string()),
                pa.array([words.word(i) for i in one.tolist()], pa.binary()),
                pa.array(b[first].astype(np.int64)),
                pa.array(n.astype(np.int64)),
            ],
            names=["lang", "word", "number", "n"],
        )


class Marks:
    """A bitmap that goes to the tasks compressed, as most of them are sparse and a worker keeps what it was sent."""

    marks: np.ndarray

    def __getstate__(self) -> dict:
        return self.__dict__ | {"marks": (self.marks.dtype.str, pack([self.marks]))}

    def __setstate__(self, state: dict) -> None:
        kind, packed = state["marks"]
        self.__dict__ |= state | {"marks": np.frombuffer(unpack(packed)[0], kind)}


@dataclass
class LastBits(Marks):
    """A set of numbers by their last bits, as a bitmap; a number that is not found is not in the set."""

    marks: np.ndarray

    def has(self, numbers: np.ndarray) -> np.ndarray:
        return in_bitmap(self.marks, numbers)


@dataclass
class TopBits(Marks):
    """A set of numbers by their first bits, in the same way."""

    bits: int
    marks: np.ndarray

    def has(self, numbers: np.ndarray) -> np.ndarray:
        slot = (numbers >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


Known = Callable[[np.ndarray], np.ndarray]  # which numbers may be frequent


def _candidate_runs(words: Words, numbers: np.ndarray, n: int, may: np.ndarray) -> np.ndarray:
    """Which runs of ``n`` words lie in one piece and begin and end with runs of a word less that may be frequent."""
    m = max(len(numbers) - n + 1, 0)
    return may[:m] & may[1 : m + 1] & (np.arange(m) + n <= _pieces(words)[:m])


def _may_be_frequent(words: Words, numbers: np.ndarray, langs: list[str], lang: np.ndarray, known: Sequence[Known]) -> list[np.ndarray]:
    """For runs of 1, 2, ... words: which may be frequent, as far as that is known."""
    out = []
    for n, has in enumerate(known, 1):
        run = run_numbers(numbers, n) if n > 1 else numbers
        may = _candidate_runs(words, numbers, n, out[-1]) if out else np.ones(len(run), bool)
        may[may] = has(_with_language(run[may], langs, lang[: len(run)][may]))
        out.append(may)
    return out


def run_bits(size: int, parts: int) -> int:
    """How many first bits of a run's number are counted: enough that few runs share them, and no more than let a number
    fit in 32 bits from the edge of its part on, so that a number takes as many bytes whatever the size."""
    return min(max(24, size.bit_length() + 6), 31 + parts.bit_length(), 60)


def _run_streams(known: Sequence[Known], bits: int, parts: int, least: int):
    """Runs of one word more than is known, of which all parts may be frequent: per chunk and part of the number range
    the runs' numbers, cut to their first bits, once each from the edge of the part on, and their counts up to
    ``least``."""
    edges = [(i << bits) // parts for i in range(parts + 1)]
    n = len(known) + 1
    kind = np.min_scalar_type(least)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, words, numbers in _chunks(batches):
            may = _may_be_frequent(words, numbers, langs, lang, known)[-1]
            inside = _candidate_runs(words, numbers, n, may)
            run = _with_language(run_numbers(numbers, n)[inside], langs, lang[: len(inside)][inside])
            run >>= np.uint64(64 - bits)
            run.sort()
            first = _firsts(run)
            counts = np.minimum(np.diff(np.append(first, len(run))), least).astype(kind)
            ids = run[first].astype(np.int64)
            cuts = np.searchsorted(ids, edges)
            own = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
            blobs = [(ids[cuts[i] : cuts[i + 1]] - edges[i]).astype(np.uint32).tobytes() for i in own]
            often = [counts[cuts[i] : cuts[i + 1]].tobytes() for i in own]
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(blobs, pa.binary()), pa.array(often, pa.binary())], names=["part", "ids", "counts"])

    return streams


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each number of an ascending array is first."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _often(pairs: np.ndarray, least: int, block: int = 1 << 19) -> np.ndarray:
    """Of ascending pairs, a number above a count of 32 bits, the numbers that add up to ``least``; block by block."""
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(pairs):
        last = pairs[min(at + block, len(pairs)) - 1] >> _COUNT_BITS
        end = int(np.searchsorted(pairs, (last << _COUNT_BITS) | _COUNT, "right"))  # a number is whole
        numbers = pairs[at:end] >> _COUNT_BITS
        first = _firsts(numbers)
        found.append(numbers[first][np.add.reduceat(pairs[at:end] & _COUNT, first) >= least].astype(np.int64))
        at = end
    return np.concatenate(found)


def _merged(bits: int, parts: int, least: int, kept_bits: int):
    """The streams of a part merged: a bitmap of the numbers that occur ``least`` times, from byte ``at`` on."""
    kind = np.min_scalar_type(least)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        ids, counts = table.column("ids"), table.column("counts")
        pairs, at = np.empty(pc.sum(pc.binary_length(ids)).as_py() // 4, np.uint64), 0
        for numbers, often in zip(ids, counts, strict=True):  # into one array that is sorted in place
            own = np.frombuffer(numbers.as_buffer(), np.uint32)
            pairs[at : at + len(own)] = (own.astype(np.uint64) << _COUNT_BITS) | np.frombuffer(often.as_buffer(), kind)
            at += len(own)
        pairs.sort()
        often = (_often(pairs, least) + (key[0].as_py() << bits) // parts) >> (bits - kept_bits)
        at = int(often[0]) >> 3 if len(often) else 0
        marks = np.zeros((int(often[-1]) >> 3) - at + 1 if len(often) else 0, np.uint8)
        first = _firsts(often >> 3)
        if len(often):
            marks[(often[first] >> 3) - at] = np.bitwise_or.reduceat(np.uint8(1) << (often & 7).astype(np.uint8), first)
        return pa.table({"at": pa.array([at], pa.int64()), "marks": pa.array([marks.tobytes()], pa.binary())})

    return merged


def frequent_runs(rows: DataFrame, known: Sequence[Known], least: int, size: int, part_bytes: int = PART_BYTES) -> TopBits:
    """Runs of one word more than is known that may occur ``least`` times in texts of ``size`` bytes."""
    parts = parts_for(size, part_bytes)
    bits = run_bits(size, parts)
    kept_bits = min(bits, KEPT_BITS)
    streams = rows.mapInArrow(tidy_batches(_run_streams(known, bits, parts, least)), "part int, ids binary, counts binary")
    merged = materialize(streams.groupBy("part").applyInArrow(tidy(_merged(bits, parts, least, kept_bits)), "at long, marks binary"))
    marks = np.zeros((1 << kept_bits) // 8, np.uint8)
    for row in merged.toLocalIterator():  # 2^KEPT_BITS bits at most, all together
        piece = np.frombuffer(row["marks"], np.uint8)
        marks[row["at"] : row["at"] + len(piece)] |= piece
    return TopBits(kept_bits, marks)


def _matrix_keys(matrix: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of numbers as binary keys, the first ``lengths`` of each."""
    inside = np.arange(matrix.shape[1])[None, :] < lengths[:, None]
    data = matrix[inside].astype(">u8")
    offsets = np.concatenate([[0], np.cumsum(lengths) * 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _phrase_streams(known: Sequence[Known], longest: int, parts: int):
    """The phrases of two words and more all of whose short runs may be frequent: per chunk, number of words and part, the
    sorted phrases as one array of numbers for each place, and their counts. One number of words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, words, numbers in _chunks(batches):
            may = _may_be_frequent(words, numbers, langs, lang, known)
            at = np.flatnonzero(may[1])
            if not len(at):
                continue
            own = np.array([language_number(x) for x in langs], np.uint64)
            columns, reach = [own[lang[at]], numbers[at]], np.ones(len(at), np.int64)
            going = np.ones(len(at), bool)
            for k in range(1, longest):
                # the longest known run that ends with word k
                n = min(k + 1, len(known))
                begin = at + k + 1 - n
                there = begin < len(may[n - 1])
                going = going & there
                going[going] = may[n - 1][begin[going]]
                reach += going
                columns.append(np.where(going, numbers[np.minimum(at + k, len(numbers) - 1)], 0).astype(np.uint64))
            # sorted once; phrases of each length are runs of equal rows
            order = np.lexsort(columns[::-1])
            for k, column in enumerate(columns):
                columns[k] = column[order]
            reach = reach[order]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for k, column in enumerate(columns):
                new[1:] |= column[1:] != column[:-1]
                if k < 2:
                    continue
                long = reach >= k
                first = np.flatnonzero(new & long)
                if not len(first):
                    continue
                # rows of one phrase lie together, and all of them are as long
                upto = np.concatenate([[0], np.cumsum(long)])
                edges = np.append(first, len(order))
                yield _dealt(k, [c[first] for c in columns[: k + 1]], upto[edges[1:]] - upto[edges[:-1]], parts)

    return count


def _dealt(k: int, rows: list[np.ndarray], counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Phrases of ``k`` words, given place by place, and their counts, by part."""
    part = (_row_numbers(rows) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    columns, cuts = [c[order] for c in (*rows, counts)], [*first.tolist(), len(order)]
    blobs = [pack([c[i:j] for c in columns]) for i, j in zip(cuts, cuts[1:])]
    return pa.record_batch(
        [pa.array(own, pa.int32()), pa.array([k] * len(own), pa.int32()), pa.array(np.diff(cuts)), pa.array(blobs, pa.binary())],
        names=["part", "words", "rows", "phrases"],
    )


def _row_numbers(rows: Sequence[np.ndarray]) -> np.ndarray:
    """A number for each row of columns."""
    out = np.zeros(len(rows[0]), np.uint64)
    for column in rows:
        out = mixed(out * _STEP + column)
    return out


def _summed(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal rows as one, their counts, which are the last column, added up; in ascending order."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.lexsort(columns[-2::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns[:-1]] + [np.add.reduceat(columns[-1], first) if len(first) else columns[-1]]


def _merged_phrases(least: int, most: int = MERGED_ROWS):
    """The streams of a part and number of words merged: key and count of the phrases that occur ``least`` times.

    The streams are read twice, one after the other: for the numbers of the phrases, which tell the few that may occur so
    often, and for those, whose counts are added up whenever ``most`` rows have come together.
    """

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        def streams() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for blob in table.column("phrases"):
                columns = [np.frombuffer(x, np.uint64) for x in unpack(blob.as_py())]
                yield columns, _row_numbers(columns[:-1]) >> _COUNT_BITS

        pairs, at = np.empty(pc.sum(table.column("rows")).as_py(), np.uint64), 0
        for columns, number in streams():
            pairs[at : at + len(number)] = (number << _COUNT_BITS) | np.minimum(columns[-1], np.uint64(least))
            at += len(number)
        pairs.sort()
        often = _often(pairs, least).astype(np.uint64)
        del pairs
        held, size, upto = [[np.zeros(0, np.uint64)] * (key[1].as_py() + 2)], 0, most
        for columns, number in streams():
            kept = np.searchsorted(often, number, "right") > np.searchsorted(often, number)
            held.append([c[kept] for c in columns])
            size += len(held[-1][0])
            if size >= upto:
                held = [_summed(held)]
                size = len(held[0][0])
                upto = max(most, 2 * size)
        *rows, n = _summed(held)
        total = n.astype(np.int64)
        matrix = np.stack(rows, axis=1)[total >= least]
        return pa.table({"key": _matrix_keys(matrix, np.full(len(matrix), matrix.shape[1])), "n": pa.array(total[total >= least])})

    return merged


# --- streams


def _key_matrix(keys: pa.ChunkedArray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    size = np.diff(offsets).astype(np.int64) // 8
    out = np.zeros((len(keys), longest + 1), np.uint64)
    # keys lie one after the other, as the places that are filled do
    inside = np.arange(longest + 1)[None, :] < size[:, None]
    out[inside] = np.frombuffer(keys.buffers()[2], ">u8", count=offsets[-1] // 8)[offsets[0] // 8 :]
    return out, size


def _laid_out(stream: DataFrame, rows: int, range_rows: int) -> DataFrame:
    """The stream with the number of its range, and the beginnings of the first key of each range in that range too.

    The bounds come from a sample; they only balance the tasks.
    """
    ranges = max(1, -(-rows // range_rows))
    bounds: list[bytes] = []
    if ranges > 1:
        drawn = stream.sample(min(1.0, 2 * SAMPLE_ROWS * ranges / rows), seed=1).select("key").limit(4 * SAMPLE_ROWS * ranges).collect()
        keys = sorted(bytes(r["key"]) for r in drawn)
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    context: dict[bytes, list[int]] = {}
    for i, bound in enumerate(bounds, 1):
        for size in range(8, len(bound), 8):
            context.setdefault(bound[:size], []).append(i)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, own, at = [], [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                home = bisect_right(bounds, key)
                for other in {home, *context.get(key, ())}:
                    part.append(other)
                    own.append(other == home)
                    at.append(i)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(own), taken.column("key"), taken.column("n")], names=["part", "own", "key", "n"])

    return stream.mapInArrow(place, "part int, own boolean, key binary, n long")


def _walk(longest: int, reverse: bool):
    """Along a range in order: for each phrase the counts of its shorter beginnings, and whether one a word longer has
    the same count. In suffix order, keys come reversed and go out as they were."""

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        matrix, size = _key_matrix(table.column("key"), longest)
        order = np.lexsort(matrix.T[::-1])
        matrix, size = matrix[order], size[order]
        n = table.column("n").to_numpy()[order]
        own = table.column("own").to_numpy(zero_copy_only=False)[order]
        place = np.arange(len(n))
        parts = np.zeros((len(n), longest), np.int64)
        covered = np.zeros(len(n), bool)
        for k in range(1, longest + 1):  # rows with k numbers: the language and k - 1 words
            last = np.maximum.accumulate(np.where(size == k, place, -1))
            longer = size > k
            parts[longer, k - 1] = n[last[longer]]
            child = np.flatnonzero(size == k + 1)
            same = child[n[child] == n[last[child]]]
            covered[last[same]] = True
        out = own | covered
        if not out.all():  # one after the other, to hold little twice
            matrix = matrix[out]
            parts = parts[out]
            size, n, own, covered = size[out], n[out], own[out], covered[out]
        if reverse:
            matrix = _reversed_words(matrix, size)
        offsets = np.arange(0, parts.size + 1, longest, dtype=np.int32)
        return pa.table(
            {
                "key": _matrix_keys(matrix, size),
                "n": pa.array(n),
                "own": pa.array(own),
                "parts": pa.ListArray.from_arrays(offsets, pa.array(parts.ravel())),
                "covered": pa.array(covered),
            }
        )

    return walk


def _reversed_words(matrix: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words of each key in reverse; the language stays first."""
    out = matrix.copy()
    for k in range(3, matrix.shape[1] + 1):  # rows with k numbers
        rows = np.flatnonzero(size == k)
        out[rows, 1:k] = matrix[rows, 1:k][:, ::-1]
    return out


def _turned(longest: int):
    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, size = _key_matrix(batch.column("key"), longest)
            yield pa.record_batch([_matrix_keys(_reversed_words(matrix, size), size), batch.column("n")], names=["key", "n"])

    return turned


def _walked(stream: DataFrame, rows: int, longest: int, reverse: bool, range_rows: int) -> DataFrame:
    """key, n, parts and covered of every phrase, in prefix or in suffix order."""
    if reverse:
        stream = materialize(stream.mapInArrow(_turned(longest), "key binary, n long"))
    laid = _laid_out(stream, rows, range_rows)
    walked = laid.groupBy("part").applyInArrow(tidy(_walk(longest, reverse)), "key binary, n long, own boolean, parts array<long>, covered boolean")
    # a phrase that is a beginning in several ranges: any of them may tell that it is covered
    return walked.groupBy("key").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("own"), F.col("parts"))).alias("parts"), F.max("covered").alias("covered")
    )


def phrase_scores(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang", range_rows: int = RANGE_ROWS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Scored phrases: key, a, l, r, n, score; and words: lang, word, number, n."""
    least = max(least, 1)  # no phrase that occurs has a lower count
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = rows.mapInArrow(tidy_batches(_count_words), "lang string, word binary, number long, n long")
    words = materialize(counted.groupBy("lang", "word").agg(F.max("number").alias("number"), F.sum("n").alias("n")))
    frequent = materialize(words.where(F.col("n") >= least).mapInArrow(_word_keys, "key binary, slot long, n long"))
    size = total_bytes(rows, "text")
    known: list[Known] = [LastBits(bitmap_of(frequent, "slot")).has]
    for _ in range(min(longest, KNOWN_RUNS) - 1):
        known.append(frequent_runs(rows, known, least, size, part_bytes).has)
    streams = _phrase_streams(known, longest, parts_for(size, part_bytes))
    phrases = rows.mapInArrow(tidy_batches(streams), "part int, words int, rows long, phrases binary")
    longer = phrases.groupBy("part", "words").applyInArrow(tidy(_merged_phrases(least)), "key binary, n long")
    all_words = words.groupBy("lang").agg(F.sum("n").alias("n")).mapInArrow(_language_keys, "key binary, n long")
    stream = materialize(longer.union(frequent.select("key", "n")).union(all_words))
    n_rows = stream.count()
    ahead = _walked(stream, n_rows, longest, False, range_rows).alias("f")
    behind = _walked(stream, n_rows, longest, True, range_rows).alias("b")
    merged = materialize(
        ahead.join(behind.hint("merge"), "key")
        .where((F.octet_length("key") >= 24) & ~F.col("f.covered") & ~F.col("b.covered"))
        .select("key", F.col("f.n").alias("a"), F.col("f.parts").alias("begins"), F.col("b.parts").alias("ends"))
    )
    size = (F.octet_length("key") / 8 - 1).cast("int")  # words; parts hold the language at 0 and k words at k
    cuts = F.transform(
        F.sequence(F.lit(1), size - 1), lambda k: F.struct(F.get("begins", k).alias("l"), F.get("ends", size - k).alias("r"), k.alias("k"))
    )
    one = merged.select("key", "a", F.get("begins", F.lit(0)).alias("n"), F.explode(cuts).alias("c")).select("key", "a", "n", "c.*")
    score = "(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(15, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    scored = one.withColumn("score", F.expr(score))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("c")
    found = scored.groupBy("key", "a", "n").agg(lowest).select("key", "a", "c.l", "c.r", "n", "c.score")
    return found, words


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = batch.column("number").to_numpy().astype(np.uint64)
        names = batch.column("lang").dictionary_encode()
        langs, lang = names.dictionary.to_pylist(), names.indices.to_numpy()
        own = np.array([language_number(x) for x in langs], np.uint64)[lang] if len(lang) else np.zeros(0, np.uint64)
        slot = _with_language(number, langs, lang).astype(np.int64)
        matrix = np.stack([own, number], axis=1)
        yield pa.record_batch([_matrix_keys(matrix, np.full(len(own), 2)), pa.array(slot), batch.column("n")], names=["key", "slot", "n"])


def _language_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.array([language_number(x) for x in batch.column("lang").to_pylist()], np.uint64).reshape(-1, 1)
        yield pa.record_batch([_matrix_keys(own, np.ones(len(own), np.int64)), batch.column("n")], names=["key", "n"])


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, text: str = "text", lang: str = "lang",
    range_rows: int = RANGE_ROWS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``best`` phrases of each language."""
    scored, words = phrase_scores(docs, longest, least, text, lang, range_rows, part_bytes)
    part = F.substring("key", 1, 8)
    # those that may be among the best, ties included, before words come back
    top = Window.partitionBy(part).orderBy(F.desc("score"), F.desc("a"))
    kept = materialize(scored.withColumn("nth", F.rank().over(top)).where(F.col("nth") <= best).drop("nth"))
    keyed = words.where(F.col("n") >= least).mapInArrow(_word_names, "word_key binary, lang string, word string")
    places = F.explode(F.sequence(F.lit(9), F.octet_length("key") - 7, F.lit(8)))
    spelled = (
        kept.withColumn("place", places)
        .withColumn("word_key", F.concat(part, F.expr("substring(key, place, 8)")))
        .join(keyed, "word_key")
        .groupBy("key", "a", "l", "r", "n", "score", "lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
        .select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "n", "score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _word_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = batch.column("number").to_numpy().astype(np.uint64)
        own = np.array([language_number(x) for x in batch.column("lang").to_pylist()], np.uint64)
        keys = _matrix_keys(np.stack([own, number], axis=1).reshape(-1, 2), np.full(len(own), 2))
        yield pa.record_batch([keys, batch.column("lang"), batch.column("word").cast(pa.string())], names=["word_key", "lang", "word"])


COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), runs AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS w
  FROM (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM starts)
), counts AS (
  SELECT lang, k, phrase, any_value(w) AS w, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), phrases AS (
  SELECT * FROM counts WHERE k >= 2 AND f >= {LEAST}
), covered AS (
  SELECT lang, array_to_string(w[1 : k - 1], ' ') AS phrase, f FROM phrases UNION
  SELECT lang, array_to_string(w[2 : k], ' ') AS phrase, f FROM phrases
), kept AS (
  SELECT * FROM phrases p WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = p.lang AND c.phrase = p.phrase AND 100 * c.f >= 100 * p.f)
), cuts AS (
  SELECT lang, phrase, f, cut, array_to_string(w[1 : cut], ' ') AS p1, array_to_string(w[cut + 1 : k], ' ') AS p2
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n, c.cut,
    CAST((CAST(1000 AS HUGEINT) * c.f * CAST(t.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.p1 JOIN counts r ON r.lang = c.lang AND r.phrase = c.p2
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {BEST}
"""


def brute_force(rows: list[tuple[str | None, str | None]], longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> list[tuple]:
    """What must come out, phrase by phrase; ``rows`` are (lang, text); for tests."""
    import re

    counts: dict[str, dict[tuple, int]] = {}
    for lang, text in rows:
        own = counts.setdefault(UNKNOWN if lang is None else lang, {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    p = tuple(words[i : i + k])
                    own[p] = own.get(p, 0) + 1
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        found = {p: f for p, f in own.items() if len(p) >= 2 and f >= least}
        inner = {}
        for p, f in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner.get(p[i : i + k], 0), f)
        scored = []
        for p, a in found.items():
            if inner.get(p, 0) < a:
                score, _, l, r = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                scored.append((score, a, " ".join(p), l, r))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i, p, a, l, r, n, score) for i, (score, a, p, l, r) in enumerate(scored[:best], 1)]
    return out
