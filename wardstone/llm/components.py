"""Connected components of a distributed edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label), label the smallest node reachable; only nodes that have an edge.

    Every round takes the smallest label of all neighbours and then the label of that label, so
    chains shrink fast; it ends when no label changes. Labels and edges stay in shared tables.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, "labels")
        root = step.select(F.col("node").alias("at"), F.col("label").alias("root"))
        jumped = step.join(root, step.label == root["at"]).select("node", "old", F.col("root").alias("label"))
        jumped = written(jumped, "labels")
        moved = not jumped.filter("label <> old").isEmpty()
        drop(labels, step)
        labels = jumped.select("node", "label")
        labels._wardstone_path = jumped._wardstone_path
        if not moved:
            drop(both)
            return labels
