"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.skew import lookup_join
from textmill.sources.scratch import checkpoint, discard


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with component the smallest node of each; ``edges(a, b)`` in any direction.

    A round hands every node the smallest label among its neighbours and then follows that label
    one step, so chains halve per round. Rounds are written, and a round's table goes once the next one
    stands; the loop ends on a round without changes. The minima are combined before the shuffle, and
    labels that many nodes share stand on the large side of a join, which adaptive execution splits.
    """
    both = checkpoint(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    )
    written = checkpoint(nodes.select(F.col("node"), F.col("node").alias("component")))
    labels = written
    while True:
        # the smallest label next to each node
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        nearest = lookup_join(both, known, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        lowered = labels.join(nearest.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("component")
        )
        # the label of that label
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = checkpoint(
            lookup_join(lowered, jump, "component").select(
                "node", "old", F.least("component", "next").alias("component")
            )
        )
        discard(written)
        written, labels = moved, moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            discard(both)
            return labels
