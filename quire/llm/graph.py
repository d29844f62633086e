"""Connected components as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of an edge.

    Each round takes the smallest label among a node and its neighbours and then the label of
    that label, so that chains shorten by halves; it ends when no label changes.  Nothing but
    the number of changes reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = written(
            labels.join(near, labels["node"] == near["a"]).select(
                "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
            )
        )
        heads = step.select(F.col("node").alias("_head"), F.col("component").alias("_of"))
        jumped = written(
            step.join(heads, step["component"] == heads["_head"]).select("node", "old", F.least("component", "_of").alias("component"))
        )
        labels = jumped.select("node", "component")
        if jumped.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
