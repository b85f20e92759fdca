"""Words of texts as arrays: byte positions, 64-bit numbers, CRC-32 sums. Texts are taken as UTF-8 bytes with A-Z
lower-cased; a word is a run of bytes of one class, and no word crosses texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from assaylane.llm.common import chunks_by_size, mixed

CHUNK = 4 << 20  # bytes of texts in one set of arrays; a longer text is alone
_LONG = 256  # bytes; longer words are hashed one by one
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*others: int | range) -> np.ndarray:
    """All bytes but the given ones."""
    table = np.ones(256, bool)
    for o in others:
        table[o if isinstance(o, int) else list(o)] = False
    return table


#: runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F], [^\x20\x09-\x0D] and [^\x20\x09.,;:!?\x0A-\x0D]
ALPHANUMERIC = byte_class(range(0x30), range(0x3A, 0x61), range(0x7B, 0x80))
NOT_SPACE = byte_class(0x20, range(0x09, 0x0E))
PUNCTUATION = ~byte_class(range(0x0A, 0x0E), *b".,;:!?")
IN_PHRASE = NOT_SPACE & ~PUNCTUATION


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words before each text, and of all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, inside: np.ndarray) -> Words:
    """Words of an Arrow array of texts; null texts have none."""
    raw, offsets = _bytes_of(texts)
    data = _LOWER[raw]
    word = inside[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | begins[:-1]))
    ends = np.flatnonzero(word & (~after | begins[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_numbers(words: Words) -> np.ndarray:
    """A 64-bit number of each word, not 0, from its bytes, eight at a time."""
    size = words.ends - words.starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x1234567))
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = np.flatnonzero(size <= _LONG)
    block = 0
    while len(at):
        piece = np.ascontiguousarray(eight[words.starts[at] + 8 * block]).view("<u8").ravel()
        out[at] = mixed(out[at] * _STEP + (piece & _MASK[np.minimum(size[at] - 8 * block, 8)]))
        block += 1
        at = at[size[at] > 8 * block]
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(words.word(i))
    return out | (out == 0)


def run_numbers(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` consecutive words, given by the words' numbers."""
    m = max(len(numbers) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mixed(out * _STEP + numbers[k : k + m])
    return out | (out == 0)


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


@cache
def _crc_shift() -> np.ndarray:
    """[n][k][b]: what byte k of a CRC register, of value b, becomes after n zero bytes."""
    crc = _crc_table()
    out = np.zeros((_LONG + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _LONG + 2):
        out[n] = crc[out[n - 1] & 0xFF] ^ (out[n - 1] >> np.uint32(8))
    return out


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    table, out = _crc_shift().ravel(), np.zeros(len(register), np.uint32)
    base = n * 1024
    for k in range(4):
        out ^= table[base + 256 * k + ((register >> np.uint32(8 * k)) & np.uint32(0xFF)).astype(np.int64)]
    return out


def run_crcs(words: Words, most: int) -> Iterator[np.ndarray]:
    """CRC-32 of every word, then of all runs of 2 to ``most`` consecutive words joined by one space. Runs that
    pass the end of a text are included and must be left out by the caller."""
    size = words.ends - words.starts
    crc, inner = _crc_table(), np.zeros(len(size), np.uint32)
    at, k = np.flatnonzero(size <= _LONG), 0
    while len(at):  # registers that start and end without the inversion, which add up
        now = inner[at]
        inner[at] = crc[(now ^ words.data[words.starts[at] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    long = np.flatnonzero(size > _LONG)
    for i in long:
        inner[i] = zlib.crc32(words.word(i)) ^ zlib.crc32(bytes(int(size[i])))
    short = np.minimum(size, _LONG)
    every = np.uint32(0xFFFFFFFF)
    last = _shifted(np.full(len(size), every), short)
    for i in long:
        last[i] = zlib.crc32(bytes(int(size[i]))) ^ every
    register = inner ^ last  # of the run so far, started with ones
    yield register ^ every
    space = np.uint32(ord(" "))
    for n in range(2, most + 1):
        m = max(len(size) - n + 1, 0)
        before = register[:m]
        spaced = crc[(before ^ space) & np.uint32(0xFF)] ^ (before >> np.uint32(8))
        register = _shifted(spaced, short[n - 1 : n - 1 + m]) ^ inner[n - 1 : n - 1 + m]
        for i in long[(long >= n - 1)]:
            register[i - n + 1] = zlib.crc32(words.word(i), int(spaced[i - n + 1] ^ every)) ^ every
        yield register ^ every


def text_chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for begin, end in chunks_by_size(sizes, most):
        yield batch.slice(begin, end - begin)
