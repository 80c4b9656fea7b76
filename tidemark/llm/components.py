"""Connected components of an edge list, by minimum labels with pointer jumping.

In each round a node takes the smallest label among its neighbours and itself, then the label of
its label.  Labels travel along paths whose length doubles, so rounds grow with the logarithm of
the longest path.  Every round is written to the shared folder, and the one before it goes; nothing is
collected but the hot nodes and labels (fewer than a thousand, see ``hot_keys``), which joins deal apart: the centre of a
star with a third of all edges is looked up by broadcast, not shuffled into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hot_keys, looked_up


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node of its component."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    crowded = hot_keys(both, "b")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = looked_up(both, "b", labels.withColumnRenamed("node", "b"), hot=crowded).groupBy("a").agg(F.min("root").alias("near"))
        step = scratch.save(labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "step")
        new = scratch.save(looked_up(step, "root", labels.select(F.col("node").alias("root"), F.col("root").alias("top"))).select("node", "old", F.least("root", "top").alias("root")), "labels")
        moved = new.filter("root <> old").limit(1).count()
        scratch.drop(labels, step)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("node", "root")


def rooted(nodes: DataFrame, node: str, labels: DataFrame, root: str = "root") -> DataFrame:
    """``nodes`` with the root of ``node``; itself where the labels don't have it."""
    got = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(got, F.col(node) == F.col("_node"), "left").withColumn(root, F.coalesce("_root", node)).drop("_node", "_root")
