"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b): component is the least node reachable.

    Each round takes the least label of a node's neighbours, then the label of that label, so that chains
    shorten by half a round; it stops when no label changes. Labels are written each round, which cuts the lineage.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        above = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        step = written(one.join(above, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
