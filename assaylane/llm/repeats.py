"""Removal of repeated passages (operator 6) by bucket-pointer refinement over a sparse suffix order.

Every window of ``LENGTH`` bytes has an anchor: the start of its 32-gram with the least identifier.
Equal windows have their anchors at the same offset, so it is enough to order the suffixes at anchors,
one in 85 or so. Buckets are first the 32-grams, whose identifiers come from those of 8 bytes by
doubling: the bucket of twice the length is the pair of the bucket here and the bucket at the later
offset. A bucket with one member is final. The others are refined: the windows of an anchor lie at
offsets 0 to 168 before it, in nodes of offsets, and the identifier of a node is made of the bucket
identifiers at later offsets. What all windows of a node have in common is compared, and what they
cover together: if the first occurs nowhere else, none of the windows does; if the second does, all
do; else the node is divided and its parts are refined in turn with the same identifiers, down to
single windows. One member of each kind that is decided stays to compare the others with. Each round is a count by identifier and a join with the counts.

Equal texts are kept once, in a table bucketed by the hash of the text, so that rounds read texts
without moving them; the bytes of a text that occurs twice are all repeated. Identifiers have 64 bits
and are compared only among members of one bucket and node.

Defined results: null counts as an empty text; texts shorter than ``LENGTH`` lose nothing; repeated
rows are copies of each other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm.common import content_key, mixed
from assaylane.session import materialize, scratch_path

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # offsets a window can have before its anchor
NODES = (32, 8, 1)  # offsets in a node, round by round
_PIECE = 1 << 18
_HIGH = np.uint64(0xFFFFFFFFFFF00000)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(text: np.ndarray) -> np.ndarray:
    """Identifier of the 32 bytes from every position on, by doubling from 8."""
    if len(text) < GRAM:
        return np.zeros(0, np.uint64)
    ids = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view("<u8").ravel()
    for later in (8, 16):
        ids = mixed(ids[:-later] * _STEP + mixed(ids[later:]))
    return ids


def span_ids(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Identifiers of spans of ``size`` bytes: those of their 32-grams at later offsets, put together."""
    out = np.full(len(starts), size, np.uint64)
    for at in [*range(0, size - GRAM, GRAM), size - GRAM]:
        out = mixed(out * _STEP + ids[starts + at])
    return out


def _owners(ids: np.ndarray) -> np.ndarray:
    """For every window of a piece the position of its anchor: the first of the least 32-grams."""
    packed = (ids & _HIGH) | np.arange(len(ids), dtype=np.uint64)
    rows = -(-len(ids) // SPAN)
    grid = np.full(rows * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(ids)] = packed
    grid = grid.reshape(rows, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(ids) - SPAN + 1
    return (np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & ~_HIGH).astype(np.int64)


def anchors(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """bucket, position, least and greatest offset of its windows, and the identifier of all that windows at
    any offset cover (0 where that passes the ends of the text)."""
    parts = []
    for begin in range(0, len(text) - LENGTH + 1, _PIECE):
        end = min(begin + _PIECE + LENGTH - 1, len(text))
        owner = _owners(gram_ids(text[begin:end])) + begin
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.append(first[1:], len(owner)) - 1
        parts.append((owner[first], first + begin, last + begin))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    # the windows of one anchor may lie on both sides of a cut: a position gives one row
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, first, last = at[begins], first[begins], last[np.append(begins[1:], len(at)) - 1]
    ids = gram_ids(text)
    whole = np.zeros(len(at), np.int64)
    fits = (at >= SPAN - 1) & (at + LENGTH <= len(text))
    whole[fits] = span_ids(ids, at[fits] - (SPAN - 1), SPAN - 1 + LENGTH).astype(np.int64)
    return ids[at].astype(np.int64), at, at - last, at - first, whole


def _bytes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint8)


def _batch(columns: dict[str, list[np.ndarray]], keys: list[tuple[int, int, int]]) -> pa.RecordBatch:
    sizes = [n for _, _, n in keys]
    named = {c: np.repeat(np.array([k[i] for k in keys], np.int64), sizes) for i, c in enumerate(("k1", "k2"))}
    named |= {c: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for c, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in named.values()], names=list(named))


_ANCHOR = "k1 long, k2 long, bucket long, at long, low long, high long, whole long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("bucket", "at", "low", "high", "whole")
        columns, keys = {n: [] for n in names}, []
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
            found = anchors(_bytes(text))
            keys.append((k1, k2, len(found[0])))
            for name, values in zip(names, found, strict=True):
                columns[name].append(values)
        yield _batch(columns, keys)


_NODE = "k1 long, k2 long, bucket long, at long, low long, high long, common long, whole long"


def _divide(size: int):
    """Nodes of ``size`` offsets of the open anchors of each text."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("bucket", "at", "low", "high", "common", "whole")
        for batch in batches:
            columns, keys = {n: [] for n in names}, []
            for k1, k2, text, flat in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "open")), strict=True):
                bucket, at, low, high = np.array(flat, np.int64).reshape(-1, 4).T
                ids = gram_ids(_bytes(text))
                n = high // size - low // size + 1
                row = np.repeat(np.arange(len(at)), n)
                node = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (low // size)[row]
                bucket, at = bucket[row], at[row]
                a, b = np.maximum(low[row], node * size), np.minimum(high[row], node * size + size - 1)
                mark = mixed(bucket.astype(np.uint64) + mixed(node.astype(np.uint64) + np.uint64(size << 20)))
                common = mixed(span_ids(ids, at - node * size, LENGTH - size + 1) + mark)
                begin = at - node * size - size + 1
                whole = np.zeros(len(row), np.uint64)
                fits = (begin >= 0) & (begin + size - 1 + LENGTH <= len(text))
                whole[fits] = mixed(span_ids(ids, begin[fits], size - 1 + LENGTH) + mark[fits]) ^ np.uint64(1)
                keys.append((k1, k2, len(row)))
                for name, values in zip(names, (bucket, at, a, b, common.astype(np.int64), whole.astype(np.int64)), strict=True):
                    columns[name].append(values)
            yield _batch(columns, keys)

    return divide


def _open(marked: DataFrame, group: str) -> DataFrame:
    """Rows to refine: those without a decision and, to compare them with, one of each kind that was decided."""
    undecided = marked.where("id IS NULL")
    needed = materialize(undecided.select(F.col(group).alias("needed")).distinct())
    kinds = marked.where("id IS NOT NULL").dropDuplicates(["whole"])
    kinds = kinds.join(needed, kinds[group] == needed["needed"], "left_semi")
    columns = ("k1", "k2", "bucket", "at", "low", "high")
    return undecided.select(*columns).union(kinds.select(*columns))


def _twice(rows: DataFrame, *keys: str) -> DataFrame:
    """Identifiers that more than one row has."""
    every = F.explode(F.array(*keys)).alias("id") if len(keys) > 1 else F.col(keys[0]).alias("id")
    return materialize(rows.select(every).where("id != 0").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))


_DONE = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")}
        columns = (batch.column(c).to_pylist() for c in ("text", "copies", "starts"))
        for text, copies, starts in zip(*columns, strict=True):
            if copies > 1 and len(text) >= LENGTH:
                spans = [0, len(text)]
            elif starts:
                ranges = np.array(starts, np.int64).reshape(-1, 2)
                ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
                begin, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + LENGTH)
                new = np.concatenate([[True], begin[1:] > end[:-1]])
                last = np.append(np.flatnonzero(new)[1:], len(end)) - 1
                spans = np.stack([begin[new], end[last]], axis=1).ravel().tolist()
            else:
                spans = []
            kept, at = hashlib.sha256(), 0
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            values = (len(text), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, spans, kept.hexdigest())
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *arrays], names=["k1", "k2", *out])


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_bytes, n_removed, n_spans, ``spans`` (byte offsets begin, end, ...), kept_sha256."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), *content_key(whole), whole.cast("binary").alias("text"))
    table = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        keyed.groupBy("k1", "k2")
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .write.bucketBy(buckets, "k1", "k2")
        .option("path", scratch_path(spark, "texts"))
        .saveAsTable(table)
    )
    try:
        texts = spark.table(table)
        long = texts.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text")
        found = materialize(long.mapInArrow(_find_anchors, _ANCHOR))  # read twice, made once
        shared = _twice(found, "bucket")
        rows = materialize(found.join(shared, found["bucket"] == shared["id"], "left_semi"))
        twice = _twice(rows, "whole")
        marked = rows.join(twice, rows["whole"] == twice["id"], "left")
        done = [materialize(marked)]
        left = _open(done[0], "bucket")
        for size in NODES:
            opened = left.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array("bucket", "at", "low", "high"))).alias("open"))
            nodes = materialize(
                texts.select("k1", "k2", "text").join(opened, ["k1", "k2"]).mapInArrow(_divide(size), _NODE)
            )
            twice = _twice(nodes, "common", "whole")
            alive = nodes.join(twice, nodes["common"] == twice["id"], "left_semi")
            # at size 1 the common part is the window itself
            ends = F.lit(True) if size == 1 else F.col("id").isNotNull()
            alive = alive.join(twice, alive["whole"] == twice["id"], "left").select(*nodes.columns, F.when(ends, 1).alias("id"))
            done.append(materialize(alive))
            if size > 1:
                left = _open(done[-1], "common")
        starts = None
        for part in done:
            own = part.where("id IS NOT NULL").select(
                "k1", "k2", F.array(F.col("at") - F.col("high"), F.col("at") - F.col("low")).alias("s")
            )
            starts = own if starts is None else starts.union(own)
        starts = starts.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("starts"))
        result = materialize(texts.join(starts, ["k1", "k2"], "left").mapInArrow(_remove, _DONE))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    joined = keyed.select("key", "k1", "k2").join(result, ["k1", "k2"])
    return joined.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What must come out, window by window; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append((len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
