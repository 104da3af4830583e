"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetra.operators.sequence import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of `edges` (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours' and its own, and then the label of that
    label, which halves long chains. Rounds go on until no label changes. Labels are combined on the map side,
    so a node with any number of neighbours gets one row from each task. Null ends are left out; direction and
    repetition of edges don't matter. No edges in, no rows out.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        better = cut_lineage(near.join(labels, F.col("a") == F.col("node"))
                             .select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        if better.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        jump = better.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        labels = cut_lineage(better.join(jump, F.col("label") == F.col("j_node")).select("node", F.col("j_label").alias("label")))
