"""Connected components of a graph, by labels that jump: for merging rules whose groups cannot leave a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moments.operators.folder import saved


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node of it. Each round takes the least label of the neighbours and then
    the label of that label, so the rounds grow with the logarithm of the longest path; every round is written, and one count is asked for."""
    both = saved(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = saved(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("seen")), "y").groupBy("x").agg(F.min("seen").alias("seen"))
        least = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("further"))
        new = saved(least.join(jump, "label").select("x", "old", F.least("label", "further").alias("label")))
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("x", "label")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
    raise ValueError(f"components of paths of more than 2^{most_rounds} nodes")
