"""Connected components as iterated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.store import write_table


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of the undirected ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label
    of that label, so chains shrink by doubling. Labels are summed up by
    partial aggregates before they move; every round is written to the shared
    folder, so a lost executor never costs more than one round.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = write_table(both.distinct(), f"{name}-edges")
    labels = write_table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("seen")), "other") \
            .groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp", "left").select("node", "old", F.coalesce(F.least("comp", "far"), "comp").alias("comp"))
        step = write_table(step, name)
        labels = step.select("node", "comp")
        if step.where(F.col("old") != F.col("comp")).isEmpty():
            return labels
