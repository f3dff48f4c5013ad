"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round: link neighbours of a node to the smallest of them.

    Large: those above the node, for each node with all its neighbours. Small: those below and the node itself.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")  # so that the join splits a node of many edges
    if large:
        linked = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = both.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for each node of edges (u, v); rows with nulls are dropped.

    Alternates large-star and small-star rounds, each stored, until the edges are stars; no node's edges are
    gathered in one place.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        now = stored(_star(_star(now, True), False), "stars")
