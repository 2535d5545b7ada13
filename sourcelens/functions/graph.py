"""Components of small graphs by relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import kept


def least_labels(links: DataFrame) -> DataFrame:
    """node, label for undirected links (a, b): label is the least node of the component.

    Every node takes the least label among its neighbours and then that label's
    own label (pointer jumping), so the number of rounds grows with the logarithm of the
    diameter on paths. Each round's labels are checkpointed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both)
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels.node == seen.a).select("node", F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("j"), F.col("label").alias("further"))
        new = kept(step.join(jump, step.label == jump.j).select("node", F.least("label", "further").alias("label")))
        old = labels.withColumnRenamed("label", "old")
        if new.join(old, "node").where("label != old").isEmpty():
            return new
        labels = new

