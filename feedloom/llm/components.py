"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); a component is named by its smallest node.

    Every round gives each node the smallest label next to it and then the label of that label;
    rounds end when none changes.  Tables stay in Spark; only a count comes back.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ccedges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "cclabels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("next"), F.col("component").alias("before"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("up_component"))
        jumped = new.join(up, F.col("next") == F.col("up"), "left").select("node", F.least("next", F.coalesce("up_component", "next")).alias("component"), "before")
        found = stage(jumped, "cclabels")
        labels = found.select("node", "component")
        if found.where("component <> before").isEmpty():
            return labels
