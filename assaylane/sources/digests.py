"""SHA-256 in steps: a digest that one task begins and another goes on with.

hashlib's objects stay in their process. The functions of OpenSSL below them keep all they know in the SHA256_CTX of
openssl/sha.h, 28 numbers of 32 bits without pointers, which can be stored as bytes and taken up by another process.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _openssl() -> ctypes.CDLL | None:
    """The library that hashlib itself runs on, or None where Python was built in another way."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
        return lib
    except (ImportError, AttributeError, OSError):
        return None


class Sha256:
    """A digest, begun or taken up from the ``state`` of another one; without OpenSSL it can only be begun."""

    def __init__(self, state: bytes | None = None):
        self._lib, self._plain = _openssl(), None
        if self._lib is None:
            if state is not None:
                raise RuntimeError("this worker's Python has no OpenSSL to go on with a digest")
            self._plain = hashlib.sha256()
        elif state is None:
            self._context = (ctypes.c_uint32 * 28)()
            self._lib.SHA256_Init(self._context)
        else:
            self._context = (ctypes.c_uint32 * 28).from_buffer_copy(state)

    def update(self, data: bytes) -> None:
        if self._plain is None:
            self._lib.SHA256_Update(self._context, data, len(data))
        else:
            self._plain.update(data)

    def state(self) -> bytes | None:
        return None if self._plain is not None else bytes(self._context)

    def hexdigest(self) -> str:
        if self._plain is not None:
            return self._plain.hexdigest()
        out, rest = ctypes.create_string_buffer(32), type(self._context).from_buffer_copy(self._context)
        self._lib.SHA256_Final(out, rest)
        return out.raw.hex()


def can_go_on() -> bool:
    """Whether a digest can be taken up here, tried on some bytes."""
    data = bytes(range(256)) * 5
    first = Sha256()
    first.update(data[:777])
    if first.state() is None:
        return False
    second = Sha256(first.state())
    second.update(data[777:])
    return second.hexdigest() == hashlib.sha256(data).hexdigest()


def workers_can_go_on(spark: SparkSession) -> bool:
    """``can_go_on`` as tried by one task for each core."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([can_go_on()] * batch.num_rows)], names=["yes"])

    n = spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).mapInArrow(tried, "yes boolean").agg(F.bool_and("yes")).first()[0]
