"""The registered queries of the analytics engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourcelens.plans import api_queries, design_queries, feature_queries

_MODULES = [design_queries, feature_queries, api_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a callable of (spark, sf_dir)."""
    return {name: q for m in _MODULES for name, q in m._QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to the DuckDB SQL that must give the same rows."""
    return {name: sql for m in _MODULES for name, sql in m._SQL.items()}
