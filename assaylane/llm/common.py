"""Helpers that several operators share: worker caches, sizes, ragged arrays, hashing in numpy."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CACHE = "_assaylane_llm_worker_cache"


def worker_cache(key: Any, build: Callable[[], Any], large: str = "") -> Any:
    """``build()`` once per Python worker process; ``key`` must name the content. Kept in ``sys.modules``, as functions that are
    shipped by value get new globals in every task. Of keys (kind, name) a worker holds the last one of each kind; a ``large``
    value goes as soon as one of another kind is built that is not used together with it, which is one of the same ``large``
    name, and its memory goes back first."""
    store = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE)).__dict__.setdefault("values", {})
    kind = key[0] if isinstance(key, tuple) else key
    if kind not in store or store[kind][0] != key:
        gone = [k for k, held in store.items() if (held[2] and held[2] != large) or k == kind]
        for k in gone:
            del store[k]
        if gone:
            release_memory()
        store[kind] = (key, build(), large)
    return store[kind][1]


def release_memory() -> None:
    """Hands freed memory back to the system, as idle Python workers stay for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A grouped function of two arguments that releases memory when it is done."""

    def run(first, second):
        out = fn(first, second)
        release_memory()
        return out

    return run


def tidy_batches(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory after the last one."""

    def run(batches):
        yield from fn(batches)
        release_memory()

    return run


def total_bytes(df: DataFrame, text: str | Column) -> int:
    """UTF-8 bytes in a text column; one pass, one number to the driver."""
    column = F.col(text) if isinstance(text, str) else text
    return df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(size: int, each: int) -> int:
    """How many parts of about ``each`` bytes hold ``size`` bytes."""
    return max(1, -(-size // each))


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two seeded 64-bit hashes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every slice, one slice after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def chunks_by_size(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of at most ``most`` together; a larger item is alone."""
    begin = held = n = 0
    for n, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield begin, n - 1
            begin, held = n - 1, 0
        held += size
    if n > begin:
        yield begin, n
