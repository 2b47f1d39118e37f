"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samefold.llm.common import staged
from samefold.storage import discard


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: label is the smallest node of node's component. edges: a, b (any orderable type).

    Each round takes the smallest label among a node's neighbours and then that label's own label
    (pointer jumping), so a path of n nodes takes about log n rounds. Each round is staged, and the
    one before it deleted."""
    pairs = edges.where(F.col("a") != F.col("b"))
    both = staged(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    before = labels
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("k"), F.col("label").alias("next"))
        step = staged(step.join(jump, F.col("label") == F.col("k")).select("node", "old", F.least("label", "next").alias("label")), "labels")
        discard(before)
        before, labels = step, step.select("node", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
