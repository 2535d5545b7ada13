"""The designs over the driver's tables: DataFrames and the same relations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_design(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """Suppliers as sources, orders as units, order status as group, quantity as mass."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    if binary:
        o = o.where(F.col("o_orderstatus").isin("F", "O"))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_suppkey").cast("string").alias("source"), F.col("l_orderkey").cast("string").alias("unit"), F.col("o_orderstatus").alias("group"), F.col("l_quantity").cast("double").alias("weight")
    )


ORDERS_SQL = """SELECT l_suppkey::VARCHAR AS source, l_orderkey::VARCHAR AS unit, o_orderstatus AS "group", l_quantity::DOUBLE AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
BINARY_SQL = ORDERS_SQL + " WHERE o_orderstatus IN ('F', 'O')"


def labels_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources, documents as units, quality labels as groups."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select("source", F.col("doc_id").cast("string").alias("unit"), F.col("quality").cast("string").alias("group"), F.lit(1.0).alias("weight"))


LABELS_SQL = """SELECT source, doc_id::VARCHAR AS unit, quality::VARCHAR AS "group", 1.0::DOUBLE AS weight FROM documents JOIN labels USING (doc_id)"""


def languages_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources, documents as units, languages as groups."""
    rows = read(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return rows.select("source", F.col("doc_id").cast("string").alias("unit"), F.col("lang").alias("group"), F.lit(1.0).alias("weight"))


LANGUAGES_SQL = """SELECT source, doc_id::VARCHAR AS unit, lang AS "group", 1.0::DOUBLE AS weight FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL"""


def segments_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with market segment, customer and nation: a design with two parent levels."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_suppkey", "l_linenumber", "o_orderkey", "c_mktsegment", "c_custkey", "c_nationkey", "l_quantity")


SEGMENTS_SQL = """SELECT l_suppkey::VARCHAR AS source, o_orderkey::VARCHAR AS unit, c_mktsegment AS "group", l_quantity::DOUBLE AS weight, c_custkey::VARCHAR AS customer,
    c_nationkey::VARCHAR AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
