"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.llm import common


def _pointed(edges: DataFrame) -> DataFrame:
    """Each node u with the least of its neighbours."""
    return common.written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v); root is the least node of the component.

    Alternates large-star and small-star steps: every node hands its neighbours
    to the least one it knows, until each points to its root. Each step is an
    aggregate with map-side combining and a join that a hub may skew, whose
    inputs are plain shuffles, so that adaptive execution can split it. Tables of
    a step are written to the shared folder; nothing is collected but a checksum.
    """
    edges = common.written(edges.where("u != v").select("u", "v").distinct(), "edges")
    last = None
    while True:
        both = common.written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = _pointed(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "large")  # u is the larger end of every edge
        small = large.join(_pointed(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = common.written(small.select("e.*").where("u != v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
        last = now
