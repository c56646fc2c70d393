"""Connected components by alternating large-star and small-star rounds over a table of edges.

Every round is two joins on node ids; edges are written to the checkpoint folder after each, never gathered. The smallest
neighbour of a node is found with partial sums before the shuffle, so a node with very many edges is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them; edges run from the larger node u to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    near = edges.join(least, "u").where("v > _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return near.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for all nodes of ``u``, ``v``; a node without edges is not in it."""
    state = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print(state)
    while before[0]:
        state = cut_lineage(_small_star(_large_star(state)))
        after = _print(state)
        if after == before:
            break
        before = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
