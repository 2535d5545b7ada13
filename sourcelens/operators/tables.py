"""Tables derived from an analytical frame (source, unit, group, weight): sparse, one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach


def source_group_weight(frame: DataFrame) -> DataFrame:
    """W: source, group, weight. Pairs of zero mass stay as rows."""
    return frame.groupBy("source", "group").agg(F.sum("weight").alias("weight"))


def pivoted(frame: DataFrame, groups: list) -> DataFrame:
    """W with a column per listed group, absent pairs 0; for presentation."""
    return frame.groupBy("source").pivot("group", groups).agg(F.sum("weight")).na.fill(0.0)


def edges(frame: DataFrame) -> DataFrame:
    """The incidence of sources and units; repeats count once, zero weights too."""
    return frame.select("source", "unit").distinct()


def unit_group(frame: DataFrame) -> DataFrame:
    """unit, group, one row per unit of a pure frame."""
    return frame.select("unit", "group").distinct()


def impure_units(frame: DataFrame) -> DataFrame:
    """Units that carry more than one group: unit, n_groups."""
    return frame.groupBy("unit").agg(F.count_distinct("group").alias("n_groups")).where("n_groups > 1")


def units_per_source(frame: DataFrame) -> DataFrame:
    return frame.groupBy("source").agg(F.count_distinct("unit").alias("n_units"))


def sources_per_unit(frame: DataFrame) -> DataFrame:
    return frame.groupBy("unit").agg(F.count_distinct("source").alias("n_sources"))


def spanning_sources(frame: DataFrame) -> DataFrame:
    """Sources with rows in more than one group, whatever their mass: source, n_groups."""
    return frame.groupBy("source").agg(F.count_distinct("group").alias("n_groups")).where("n_groups > 1")


def counts(frame: DataFrame) -> DataFrame:
    """One row: n_rows, n_sources, n_units, n_groups, total_weight."""
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.count_distinct("unit").alias("n_units"),
        F.count_distinct("group").alias("n_groups"), F.sum("weight").alias("total_weight"),
    )


def duplicate_counts(frame: DataFrame) -> DataFrame:
    """One row: n_duplicate_keys, n_duplicate_rows (rows beyond the first of a repeated key)."""
    per = frame.groupBy("source", "unit", "group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.agg(F.count(F.lit(1)).alias("n_duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_rows"))


def describe(frame: DataFrame) -> DataFrame:
    """One row of sizes, degrees (exact medians) and duplicates."""
    ups = units_per_source(frame).agg(F.median("n_units").alias("units_per_source_median"), F.max("n_units").alias("units_per_source_max"))
    spu = sources_per_unit(frame).agg(
        F.median("n_sources").alias("sources_per_unit_median"), F.max("n_sources").alias("sources_per_unit_max"),
        F.count_if(F.col("n_sources") == 1).alias("units_with_one_source"),
    )
    span = spanning_sources(frame).agg(F.count(F.lit(1)).alias("n_spanning_sources"))
    out = counts(frame)
    for part in (duplicate_counts(frame), ups, spu, span):
        out = attach(out, part)
    return out
