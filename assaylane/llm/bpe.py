"""Byte-level BPE encoding and decoding (operator 1).

A global distinct-word shuffle. Documents are dealt into blocks of about ``BLOCK_BYTES``. Each block
explodes its texts into pre-tokens with positions and sends every distinct word once, packed by word
shard. A shard meets the words of all blocks, encodes each distinct word once, and answers every
block in the order it asked. Blocks and answers are then joined, and the ids are reassembled by
position. Words are matched by 64-bit hashes; every block compares the bytes of its result with the
texts, and a range of texts that differs is encoded again text by text, so that the result is exact.

Decoding joins the ids with the token-byte table. That table has one row per token of the vocabulary
file, so its size is bound by that file, and it is sent to all tasks.

Defined results: a null text encodes like an empty one, to no ids; repeated rows each get a result;
columns that are not named in ``keep`` are ignored whatever their names; an empty table gives an
empty table; a null in an id column is kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm import pretokens
from assaylane.llm.common import chunks_by_size, parts_for, ragged_index, tidy, total_bytes, worker_cache

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 48 << 20  # bytes of text for each word shard


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file of base64 lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={}
    )


def encoder(path: str):
    """The public encoder, once per worker."""
    return worker_cache(("encoder", path), lambda: _encoder(path), large="bpe")


class TokenBytes:
    """The bytes of every token, end to end."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        words = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            words[rank] = token
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the length of each."""
        lengths = self.lengths[ids]
        return self.bytes[ragged_index(self.starts[ids], lengths)], lengths


def token_bytes(path: str) -> TokenBytes:
    return worker_cache(("bytes", path), lambda: TokenBytes(path), large="bpe")


class Block:
    """The pre-tokens of many texts: distinct words, and the texts as positions in them.

    Texts stay in the Arrow column; those of one range at a time are strings.
    """

    def __init__(self, texts: pa.Array, with_words: bool) -> None:
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        known, hashes, words = np.zeros(0, np.uint64), [], [pa.array([], pa.large_string())]
        for begin, end in chunks_by_size(pc.utf8_length(texts).to_numpy().tolist(), pretokens.CHUNK_CHARS):
            split = pretokens.split(texts[begin:end].to_pylist())
            unique, where, codes = np.unique(split.hashes(), return_index=True, return_inverse=True)
            self.parts.append((begin, end, unique, codes.astype(np.int32), split.first))
            new = ~np.isin(unique, known, assume_unique=True)
            if with_words:
                text, at = split.text, where[new]
                places = zip(split.starts[at].tolist(), split.starts[at + 1].tolist(), strict=True)
                words.append(pa.array([text[a:b] for a, b in places], pa.large_string()))
                hashes.append(unique[new])
            known = np.union1d(known, unique[new])
        self.distinct = known
        if hashes:  # in the order of the distinct hashes
            self.words = pa.concat_arrays(words).take(pa.array(np.argsort(np.concatenate(hashes))))

    def ids(self, counts: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each range of texts: begin, end, ids of the range, and where each text starts in them.

        ``counts`` and ``ids``: for the distinct words in order.
        """
        starts = np.cumsum(counts) - counts
        for begin, end, unique, codes, first in self.parts:
            word = np.searchsorted(self.distinct, unique)[codes]
            lengths = counts[word]
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            yield begin, end, ids[ragged_index(starts[word], lengths)], bounds[first]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def pack(arrays: list[np.ndarray | bytes]) -> bytes:
    """Arrays as one compressed value."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, parts = 8 * (n + 1), []
    for size in sizes:
        parts.append(raw[at : at + size])
        at += size
    return parts


def narrow(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers in as few bytes as all of them fit in, and before them the type."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.str.encode(), values.astype(kind)


def widened(parts: list[bytes]) -> list[np.ndarray]:
    """The arrays that ``narrow`` was given, from types and numbers by turns."""
    return [np.frombuffer(raw, kind.decode()).astype(np.uint32) for kind, raw in zip(parts[::2], parts[1::2], strict=True)]


def _texts(table: pa.Table) -> pa.Array:
    """The texts in one array; a null is empty. Offsets have 64 bits, as a group may pass 2 GB."""
    return pc.fill_null(table.column("text").cast(pa.large_string()).combine_chunks(), "")


def _ask(shards: int):
    """Block of texts -> its distinct words by shard."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(_texts(table), with_words=True)
        shard = shard_of(block.distinct, shards)
        rows = []
        for s in np.unique(shard).tolist():
            words = block.words.take(pa.array(np.flatnonzero(shard == s)))
            sizes = pc.binary_length(words).to_numpy().astype(np.uint32)
            rows.append((s, key[0].as_py(), pack([sizes, words.buffers()[2].to_pybytes()[: int(sizes.sum(dtype=np.int64))]])))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table(
            {
                "shard": pa.array(columns[0], pa.int64()),
                "block": pa.array(columns[1], pa.int64()),
                "words": pa.array(columns[2], pa.binary()),
            }
        )

    return tidy(ask)


def _answer(path: str):
    """Words of one shard, asked for by many blocks -> their ids, block by block."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        one = encoder(path)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        answers = []
        for packed in table.column("words"):
            sizes, joined = unpack(packed.as_py())
            ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
            counts, ids, begin = [], [], 0
            for end in ends:
                word = joined[begin:end]
                begin = end
                got = known.get(word)
                if got is None:
                    got = known[word] = one(word)
                counts.append(len(got))
                ids += got
            answers.append(pack([x for values in (counts, ids) for x in narrow(np.array(values, np.uint32))]))
        return pa.table(
            {"shard": table.column("shard"), "block": table.column("block"), "ids": pa.array(answers, pa.binary())}
        )

    return tidy(answer)


def _own_ids(path: str, text: str) -> bytes:
    """The ids of one text by the encoder alone."""
    return np.array(encoder(path).encode_ordinary(text), "<u4").tobytes()


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """Values that lie one after the other; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _decoded(path: str, ids: bytes) -> bytes:
    """The bytes of the ids of one text."""
    return token_bytes(path).join(np.frombuffer(ids, "<u4"))[0].tobytes()


def _assemble(path: str, shards: int, schema: pa.Schema, with_decoded: bool):
    """Texts of a block and the answers it got -> the ids of every text, and the bytes that they decode to."""

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        plain = _texts(texts)
        block = Block(plain, with_words=False)
        shard = shard_of(block.distinct, shards)
        counts, ids = np.zeros(len(block.distinct), np.int64), []
        order = []
        for s, packed in zip(answers.column("shard").to_pylist(), answers.column("ids"), strict=True):
            own = np.flatnonzero(shard == s)
            got, of_words = widened(unpack(packed.as_py()))
            counts[own] = got
            order.append(own)
            ids.append(of_words)
        if order:  # from shard by shard to the order of the hashes
            placed, joined = np.concatenate(order), np.concatenate(ids)
            lengths = counts[placed]
            starts = np.zeros(len(counts), np.int64)
            starts[placed] = np.cumsum(lengths) - lengths
            joined = joined[ragged_index(starts, counts)]
        else:
            joined = np.zeros(0, np.uint32)
        table, columns, back = token_bytes(path), [pa.array([], pa.binary())], [pa.array([], pa.binary())]
        at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset :]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
        for begin, end, of_range, first in block.ids(counts, joined):
            decoded, lengths = table.join(of_range)
            ends = np.concatenate([[0], np.cumsum(lengths)])[first]
            bounds = at[begin : end + 1]
            if np.array_equal(ends, bounds - bounds[0]) and np.array_equal(decoded, data[bounds[0] : bounds[-1]]):
                columns.append(_binary(first * 4, of_range.astype("<u4").tobytes()))
                if with_decoded:
                    back.append(_binary(ends, decoded.tobytes()))
            else:
                own = [_own_ids(path, t) for t in plain[begin:end].to_pylist()]
                columns.append(pa.array(own, pa.binary()))
                if with_decoded:
                    back.append(pa.array([_decoded(path, v) for v in own], pa.binary()))
        out = texts.drop_columns(["block", "text"]).append_column("ids", pa.chunked_array(columns))
        if with_decoded:
            out = out.append_column("decoded", pa.chunked_array(back))
        return out.cast(schema)

    return tidy(assemble)


def encode(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_decoded: bool = False
) -> DataFrame:
    """The ids of every whole text, as little-endian unsigned 32-bit integers in ``ids``.

    ``path``: a vocabulary file that the executors can read, too. ``keep``: columns to carry along. ``with_decoded`` adds
    what ``decode`` would: the ids are joined with the token-byte table where they are made, in the same Python worker.
    """
    size = total_bytes(docs, text)
    blocks, shards = parts_for(size, BLOCK_BYTES), parts_for(size, SHARD_BYTES)
    names = [f"kept{i}" for i in range(len(keep))]
    dealt = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
        F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(*keep, text), F.lit(blocks)).cast("bigint").alias("block"),
    )
    asked = dealt.groupBy("block").applyInArrow(_ask(shards), "shard long, block long, words binary")
    answered = asked.groupBy("shard").applyInArrow(_answer(path), "shard long, block long, ids binary")
    kept = dealt.select(*names)
    from pyspark.sql.pandas.types import to_arrow_schema

    made = ["ids", "decoded"] if with_decoded else ["ids"]
    schema = to_arrow_schema(kept.schema)
    for name in made:
        schema, kept = schema.append(pa.field(name, pa.binary())), kept.withColumn(name, F.lit(b""))
    done = (
        dealt.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(_assemble(path, shards, schema, with_decoded), kept.schema)
    )
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *made)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids; null for null ids."""

    @F.pandas_udf("binary")
    def join_bytes(column: pd.Series) -> pd.Series:
        table = token_bytes(path)
        raw = [np.frombuffer(v, "<u4") if v is not None else np.zeros(0, np.uint32) for v in column]
        out: list[bytes | None] = []
        for begin, end in chunks_by_size((len(r) for r in raw), 1 << 20):
            joined, lengths = table.join(np.concatenate(raw[begin:end]))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            bounds = ends[np.concatenate([[0], np.cumsum([len(r) for r in raw[begin:end]])])].tolist()
            whole = joined.tobytes()
            out += [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return pd.Series([None if v is None else o for v, o in zip(column, out, strict=True)], dtype=object)

    return encoded.withColumn("decoded", join_bytes(ids))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes ``documents``: counts, and SHA-256 of ids and of decoded bytes."""
    return encode(docs, path, with_decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def digest_of(text: str | None, path: str) -> tuple[int, str, str]:
    """What ``digests`` must give for one text, with the library alone; for tests."""
    ids = _encoder(path).encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
