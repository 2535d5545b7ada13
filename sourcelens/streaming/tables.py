"""Incremental maintenance of the sufficient tables over a stream of observations.

An extension: mass per (source, group) and distinct edges are sums and sets
that merge, so a stream can keep them up to date; every diagnostic then reads
the small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcelens.functions.keys import KeySpec, key


def observations(stream: DataFrame, *, source: KeySpec, unit: KeySpec, group: KeySpec, weight: str | None = None) -> DataFrame:
    """Complete, normalized observations of a stream: source, unit, group, weight. Weights must be finite and not negative."""
    mass = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = stream.select(key(source).alias("source"), key(unit).alias("unit"), key(group).alias("group"), mass.alias("weight"), *_event_time(stream))
    good = (F.col("weight") >= 0) & (F.col("weight") < float("inf"))
    return rows.where("source is not null and unit is not null and `group` is not null").where(good)


def _event_time(stream: DataFrame) -> list[str]:
    return [c for c, t in stream.dtypes if t == "timestamp" and c == "event_time"]


def mass_table(rows: DataFrame) -> DataFrame:
    """Running W; write it in complete or update mode."""
    return rows.groupBy("source", "group").agg(F.sum("weight").alias("weight"))


def windowed_mass(rows: DataFrame, window: str, late: str) -> DataFrame:
    """W per event-time window; rows later than `late` behind the newest are left out. Needs a timestamp column event_time."""
    return rows.withWatermark("event_time", late).groupBy(F.window("event_time", window), "source", "group").agg(F.sum("weight").alias("weight"))


def edge_stream(rows: DataFrame) -> DataFrame:
    """Each (source, unit, group) once, as it first appears."""
    return rows.select("source", "unit", "group").dropDuplicates()


def start_mass(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps W in an in-memory table that diagnostics can query."""
    return mass_table(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
