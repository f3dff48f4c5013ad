"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the edges (u, v) between numbers.

    In each round every node takes the smallest label among its neighbours' and its own, and then the label of
    that label, until no label moves; rounds are few, as the second step halves chains. Each round is stored.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    now = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("best"))
        low = stored(now.join(near, now["node"] == near["u"]).select("node", "label", F.least("label", "best").alias("low")), "labels")
        ahead = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        moved = stored(low.join(ahead, "low").select("node", F.least("low", "jump").alias("next"), "label"), "labels")
        now = moved.select("node", F.col("next").alias("label"))
        if moved.where("next <> label").isEmpty():
            return now.select("node", F.col("label").alias("component"))
