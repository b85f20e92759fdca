"""Exact top-k search (operator 5) by distributed histogram selection.

All queries meet all vectors in cells of a query block and a vector shard; a cell is one matrix
product. Nothing but histograms leaves a cell at first: each round counts, per query, the scores in
256 equal bins of the interval in which the k-th score lies, and the interval shrinks to one bin.
When it holds one value, that value is the k-th score. A last pass keeps the scores above it and, of
those equal to it, the smallest ids; ranking them is a window over at most k rows per cell.

A histogram leaves out bins that lie below the cell's own k-th score, which the global one cannot be
in. Sums are exact: products run in floating point only where the largest possible sum fits the
mantissa, else in 64-bit integers; vectors whose scores may pass 64 bits are refused with an error.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; a shorter vector counts as padded with zeros; a query that is repeated with the
same id and vector is answered once; each repeated row is a candidate of its own; rows with the
query's id are not candidates; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.session import materialize

BINS = 256
SHARD_ROWS, QUERY_ROWS = 8_192, 1_024
SLICE_ROWS = 128  # queries of one product

_STATE = "query long, query_id long, q array<long>, lo long, hi long, above long"


def quantized(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * component), without the rows that take no part."""
    x = F.col(vector)
    valid = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return (
        vectors.where(F.col(key).isNotNull() & x.isNotNull())
        .where(valid)
        .select(
            F.col(key).cast("long").alias("vec_id"),
            F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"),
        )
    )


def _norm2(q: str) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def _matrix(column: pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _slices(queries: pa.Table, vectors: pa.Table, dim: int, kind: type):
    """For slices of the queries: their rows, and their scores; no score with the own id."""
    ids = vectors.column("vec_id").to_numpy()
    c = _matrix(vectors.column("q"), dim, kind).T
    all_q = _matrix(queries.column("q"), dim, kind)
    own = queries.column("query_id").to_numpy()
    for a in range(0, len(all_q), SLICE_ROWS):
        rows = slice(a, a + SLICE_ROWS)
        scores = (all_q[rows] @ c).astype(np.int64)
        yield rows, scores, ids[None, :] != own[rows, None]


def _histogram(dim: int, kind: type, k: int):
    def histogram(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        lo, hi, above = (queries.column(n).to_numpy() for n in ("lo", "hi", "above"))
        keys, bins, counts = [], [], []
        if len(vectors) and len(queries):
            width = -(-(hi - lo) // BINS)
            key = queries.column("query").to_numpy()
            for rows, scores, other in _slices(queries, vectors, dim, kind):
                low, n = lo[rows, None], scores.shape[0]
                at, column = np.nonzero(other & (scores >= low) & (scores < hi[rows, None]))
                place = (scores[at, column] - lo[rows][at]) // width[rows][at]
                table = np.bincount(at * BINS + place, minlength=n * BINS).reshape(n, BINS)
                higher = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
                q, b = np.nonzero((table > 0) & (higher < (k - above[rows])[:, None]))
                keys.append(key[rows][q])
                bins.append(b)
                counts.append(table[q, b])
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        return pa.table({"query": join(keys), "bin": join(bins), "n": join(counts)})

    return histogram


def _pick(dim: int, kind: type, k: int):
    def pick(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            key, own, lo, above = (queries.column(n).to_numpy() for n in ("query", "query_id", "lo", "above"))
            order = np.argsort(vectors.column("vec_id").to_numpy(), kind="stable")
            vectors = vectors.take(pa.array(order))
            ids = vectors.column("vec_id").to_numpy()
            for rows, scores, other in _slices(queries, vectors, dim, kind):
                at, column = np.nonzero(other & (scores >= lo[rows, None]))
                value = scores[at, column]
                tied = value == lo[rows][at]
                nth = np.cumsum(tied) - 1  # ties of a query, by id
                first = np.zeros(scores.shape[0], np.int64)
                np.add.at(first, at, tied)
                nth -= (np.cumsum(first) - first)[at]
                take = ~tied | (nth < (k - above[rows])[at])
                at, column = at[take], column[take]
                for name, values in zip(out, (key[rows][at], own[rows][at], ids[column], value[take]), strict=True):
                    out[name].append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for n, v in out.items()})

    return pick


def top_k(
    vectors: DataFrame, k: int, every: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for each whose id is divisible by ``every``."""
    table = materialize(quantized(vectors, key, vector, scale))
    queries = table.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"])
    facts = table.select(F.count("*").alias("rows"), F.max(F.size("q")).alias("dim"), F.max(_norm2("q")).alias("norm2")).first()
    rows, dim, bound = facts["rows"], facts["dim"] or 0, (facts["norm2"] or 0.0) * 1.000001
    if bound >= 2.0**62:
        raise ValueError("components are too large for 64-bit scores")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    shards, blocks = -(-rows // SHARD_ROWS) or 1, -(-queries.count() // QUERY_ROWS) or 1
    cell = lambda block, shard: (F.col(block) * shards + F.col(shard)).alias("cell")
    candidates = table.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).alias("shard"),
        "vec_id",
        "q",
    ).select(cell("block", "shard"), "vec_id", "q")

    def cells(state: DataFrame) -> DataFrame:
        return state.select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
            F.pmod(F.col("query"), F.lit(blocks)).alias("block"),
            "*",
        ).select(cell("block", "shard"), *state.columns)

    reach = (F.ceil(F.sqrt(_norm2("q") * F.lit(bound))) + 1).cast("long")
    state = materialize(
        queries.select(
            F.xxhash64("vec_id", "q").alias("query"),
            F.col("vec_id").alias("query_id"),
            "q",
            (-reach).alias("lo"),
            (reach + 1).alias("hi"),
            F.lit(0).cast("long").alias("above"),
        )
    )
    while (state.select(F.max(F.col("hi") - F.col("lo")).alias("w")).first()["w"] or 0) > 1:
        counted = (
            cells(state)
            .groupBy("cell")
            .cogroup(candidates.groupBy("cell"))
            .applyInArrow(_histogram(dim, kind, k), "query long, bin long, n long")
        )
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        summed = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        summed = summed.withColumn("upto", F.sum("n").over(down))
        low = F.col("lo") + F.col("bin") * F.ceil((F.col("hi") - F.col("lo")) / BINS).cast("long")
        width = F.ceil((F.col("hi") - F.col("lo")) / BINS).cast("long")
        found = F.col("bin").isNotNull()
        state = materialize(
            state.join(summed, "query", "left")
            .where(~found | (F.col("above") + F.col("upto") >= k))
            .groupBy("query")
            .agg(F.max("bin").alias("bin"), F.max_by(F.col("upto") - F.col("n"), "bin").alias("higher"))
            .join(state, "query", "right")
            .select(
                "query",
                "query_id",
                "q",
                # with fewer than k scores there is no bin: everything from the lowest score on is kept
                F.when(found, low).otherwise(F.col("lo")).alias("lo"),
                F.when(found, F.least(low + width, "hi")).otherwise(F.col("lo") + 1).alias("hi"),
                (F.col("above") + F.coalesce("higher", F.lit(0))).alias("above"),
            )
        )
    picked = (
        cells(state)
        .groupBy("cell")
        .cogroup(candidates.groupBy("cell"))
        .applyInArrow(_pick(dim, kind, k), "query long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        picked.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
