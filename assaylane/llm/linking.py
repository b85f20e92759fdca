"""Connected components of similar sets that share keys, without a pair for each two members of a key.

The sets are compared exactly, but not all of them. First, the members of a rare key meet each other and those of a
common one meet two of them only. Components of the links so proven spare all pairs inside them. What is left are the
common keys whose members are in several components. Keys with the same largest component are one family, so that
members with many common keys are compared once. Members outside the largest component meet the others in blocks, by
weights and by parity bits: every unit of a set flips one bit of a hashed array, so the number of bits in which two
sets differ is never more than the number of units in which they do. A pair that passes that bound is checked on the
whole sets. At first a block gives only a forest of its pairs, then, for what those have left apart, all pairs between
different components. No link that joins two components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.llm.common import mixed, tidy_batches
from assaylane.llm.components import components
from assaylane.session import materialize

FEW = 8  # members of a key that all meet each other
BLOCK = 2_048  # members of a family that are compared at once
_SLICE = 64
PARITY_BITS = 8  # bits for each unit of weight
DETAILS = "weight long, parity binary, cells array<long>"


def parity(cells: np.ndarray) -> bytes:
    """The parity bits of a set of 64-bit numbers; their number is a power of two, and 64 at least."""
    bits = 1 << max(6, int(PARITY_BITS * max(len(cells), 1) - 1).bit_length())
    slot = (mixed(cells) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def detail_arrays(cells: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """The columns ``DETAILS`` of sets that lie one after the other, each in ascending order."""
    ends = np.cumsum(sizes)
    bits = [parity(cells[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return [pa.array(sizes.astype(np.int64)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(cells.astype(np.int64)))]


def fits(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Weights that leave room for the threshold."""
    num, den = share
    return den * np.minimum(a, b) >= num * np.maximum(a, b)


def _similar(share: tuple[int, int]):
    """Exact check of pairs of sets; equal numbers of one set are units of their own."""
    num, den = share

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sides = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("a", "b")]
            (at_a, a), (at_b, b) = sides
            for i in range(len(batch)):
                both = np.concatenate([a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = den * common >= num * (len(both) - common)
            yield pa.record_batch([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])

    return similar


def _may_be_similar(share: tuple[int, int]):
    """Leaves out pairs whose weights or parity bits rule them out."""
    num, den = share

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            keep = fits(a, b, share)
            p, q = (batch.column(c).to_pylist() for c in ("p", "q"))
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(v[i], np.uint64).reshape(1, -1) for v in (p, q))
                words = min(x.shape[1], y.shape[1])
                differ = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
                keep[i] = differ * (den + num) <= (den - num) * int(a[i] + b[i])
            yield pa.record_batch([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])

    return may


def proven(pairs: DataFrame, details: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs u, v of nodes whose sets reach the threshold, each once. Whole sets meet only where the parity bits
    leave it open."""
    once = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a = details.select(F.col("node").alias("u"), F.col("weight").alias("a"), F.col("parity").alias("p"))
    b = details.select(F.col("node").alias("v"), F.col("weight").alias("b"), F.col("parity").alias("q"))
    open_ = materialize(once.join(a, "u").join(b, "v").mapInArrow(tidy_batches(_may_be_similar(share)), "u long, v long"))
    a = details.select(F.col("node").alias("u"), F.col("cells").alias("a"))
    b = details.select(F.col("node").alias("v"), F.col("cells").alias("b"))
    both = open_.join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return materialize(both.mapInArrow(tidy_batches(_similar(share)), "u long, v long"))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    node, root, weight = (table.column(c).to_numpy() for c in ("node", "root", "weight"))
    order = np.argsort(weight, kind="stable")
    parity_ = table.column("parity").to_pylist()
    return node[order], root[order], weight[order], [np.frombuffer(parity_[i], np.uint64) for i in order]


def _levels(rows: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """Ranges of rows with arrays of one size, as matrices. Sizes ascend with the weights."""
    out, begin = [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or len(rows[i]) != len(rows[begin]):
            out.append((begin, i, np.stack(rows[begin:i])))
            begin = i
    return out


def _folded(matrix: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of fewer slots: those that become one are added up."""
    while matrix.shape[1] > words:
        half = matrix.shape[1] // 2
        matrix = matrix[:, :half] ^ matrix[:, half:]
    return matrix


def _close(left: tuple, right: tuple, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of the left and j of the right side that may be similar, of different roots, and the differing bits."""
    num, den = share
    _, roots_l, weights_l, bits_l = left
    _, roots_r, weights_r, bits_r = right
    for a, b, own in _levels(bits_l):
        for c, d, other in _levels(bits_r):
            (low, high), (least, most) = (weights_l[a], weights_l[b - 1]), (weights_r[c], weights_r[d - 1])
            if (high < least and not fits(high, least, share)) or (most < low and not fits(most, low, share)):
                continue
            words = min(own.shape[1], other.shape[1])
            x, y = _folded(own, words), _folded(other, words)
            for begin in range(0, len(x), _SLICE):
                part = slice(begin, begin + _SLICE)
                u, v = weights_l[a:b][part, None], weights_r[None, c:d]
                may = fits(u, v, share) & (roots_l[a:b][part, None] != roots_r[None, c:d])
                i, j = np.nonzero(may)
                for at in range(0, len(i), 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    differ = np.bitwise_count(x[part][p] ^ y[q]).sum(axis=1, dtype=np.int64)
                    # similar sets differ in at most (1 - t) / (1 + t) of their units
                    ok = differ * (den + num) <= (den - num) * (u[p, 0] + v[0, q])
                    yield a + begin + p[ok], c + q[ok], differ[ok]


def _compare(share: tuple[int, int], forest: bool):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            left, right = _arrays(left), _arrays(right)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for i, j, differ in _close(left, right, share):
                if forest:  # the closest pairs first, one for each two components
                    keep = []
                    for at in np.argsort(differ, kind="stable").tolist():
                        a, b = top(int(left[1][i[at]])), top(int(right[1][j[at]]))
                        if a != b:
                            parent[a] = b
                            keep.append(at)
                    i, j = i[keep], j[keep]
                u.append(left[0][i])
                v.append(right[0][j])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return compare


def _between(held: DataFrame, details: DataFrame, roots: DataFrame, share: tuple[int, int], forest: bool, block: int) -> DataFrame:
    """Pairs that may be similar, of members of common keys in different components. ``held``: node and the list of its
    common keys, so that a node meets its root once and not once for each key."""
    rooted = held.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "keys")
    labelled = materialize(rooted.select(F.explode("keys").alias("key"), "node", "root"))
    by_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed_keys = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("family"))
    family = materialize(labelled.join(mixed_keys.where("roots > 1").select("key", "family"), "key").select("family", "node", "root").distinct())
    sizes = family.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("family")).alias("m"))
    blocks = sizes.select("family", F.ceil(F.col("n") / block).cast("long").alias("all"), F.ceil(F.col("m") / block).cast("long").alias("outside"))
    members = materialize(family.join(blocks, "family").join(details.select("node", "weight", "parity"), "node"))
    hashed = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("family", "i", "j", "node", "root", "weight", "parity")
    left = members.where("root != family").withColumn("i", F.pmod(hashed, F.col("outside"))).withColumn("j", every("all")).select(*columns)
    right = members.toDF(*members.columns).withColumn("j", F.pmod(hashed, F.col("all"))).withColumn("i", every("outside")).select(*columns)
    keys = ("family", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(share, forest), "u long, v long")


def with_sizes(every: DataFrame) -> DataFrame:
    """Members of keys that several have, each with the number n of its key's members and the ``low`` and ``high`` ones.
    ``every``: key, node, weight, each once."""
    sizes = every.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    return materialize(every.join(sizes.where("n > 1"), "key"))


def linked(keyed: DataFrame, details: DataFrame, share: tuple[int, int], few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes with a link. ``keyed``: key, node, weight of members of keys, each once, or what
    ``with_sizes`` has made of them; ``details``: node and ``DETAILS``; ``share``: the threshold as a fraction."""
    num, den = share
    sized = keyed if "n" in keyed.columns else with_sizes(keyed)
    members = F.array_sort(F.collect_list(F.struct("weight", "node")))
    lists = sized.where(F.col("n") <= few).groupBy("key").agg(members.alias("m"))
    later = lambda a, i: F.filter(  # noqa: E731  members of up to a / threshold that come later
        F.slice("m", i + 2, few), lambda b: den * a["weight"] >= num * b["weight"]
    )
    pairs_of = lambda a, i: F.transform(later(a, i), lambda b: F.struct(a["node"].alias("u"), b["node"].alias("v")))
    near = lists.select(F.explode(F.flatten(F.transform("m", pairs_of))).alias("p")).select("p.u", "p.v")
    common = sized.where(F.col("n") > few)
    ends = common.select(F.col("node").alias("u"), F.explode(F.array("low", "high")).alias("v"))
    first = proven(near.union(ends), details, share)
    roots = materialize(components(first))
    held = materialize(common.groupBy("node").agg(F.collect_list("key").alias("keys")))
    if held.isEmpty():
        return roots
    for forest in (True, False):
        found = proven(_between(held, details, roots, share, forest, block), details, share)
        if not found.isEmpty():
            known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = materialize(components(known.union(found)))
    return roots
