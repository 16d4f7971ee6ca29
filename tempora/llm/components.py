"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.session import materialize


def _digest(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"),
               F.sum(F.expr("pmod(xxhash64(v, u), 1000000007)"))).first()
    return tuple(r)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link to another; root is the least node.

    Each round joins links with one row a node, never with each other, so a hub costs as many
    rows as it has links; these rows of a node are written first, so both sides of the join are
    plain exchanges and Spark can split a hub's links over several tasks. The number of rounds
    grows with the logarithm of the longest path. Every round is written to the shared checkpoint folder. Self links and repeats are ignored;
    nulls are no nodes; an empty table gives an empty result.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialize(e, "links")
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # large star: every larger neighbour of a node points to the node's least neighbour
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = materialize(large, "links")
        # small star: every smaller neighbour, and the node itself, points to the least one
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = materialize(small, "links")
        now = _digest(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
