"""Connected components by alternating large-star and small-star steps.

Each step is one grouped minimum and one equality join; nothing but a row
count and a checksum comes to the driver, and every round is written to the
shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large star: every larger neighbour of a node is linked
    to the node's smallest neighbour or itself. Small star: every smaller
    neighbour, and the node itself, to the smallest neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected(pairs: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) of every node that is
    in a pair; pairs of long columns ``a`` and ``b`` may repeat."""
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u > v").distinct(), "star")

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]

    before = state(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        edges = materialize(_star(_star(edges, True), False), "star")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
