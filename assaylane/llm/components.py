"""Connected components of a table of links, by large-star and small-star rounds; nothing goes to the driver
but two numbers per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylane.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Every link next to the least v of its u: sums before the shuffle and a join, as a node may have very many links."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = _least(edges)
    return down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another one; the root is the least node of the component.

    ``links`` has the columns u and v. A round writes two tables.
    """
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, mark = materialize(down.where("u != v").distinct()), None
    while True:
        now = tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        large = materialize(_large_star(edges).distinct())
        edges = materialize(_small_star(large).where("u != v").distinct())
