"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourcelens.llm import bpe, exact, jaccard, langid, licenses, lines, mixing, quality, substrings, urls

_QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact": exact.op3_exact,
    "op4_quality": quality.op4_quality,
    "op5_urls": urls.op5_urls,
    "op6_lines": lines.op6_lines,
    "op7_mix": mixing.op7_mix,
    "op8_substrings": substrings.op8_substrings,
    "op9_langid": langid.op9_langid,
    "op10_jaccard": jaccard.op10_jaccard,
}

_ORACLES: dict[str, str] = {
    "op3_exact": exact.ORACLE,
    "op4_quality": quality.ORACLE,
    "op7_mix": mixing.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a callable of (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to the DuckDB SQL that must give the same rows."""
    return dict(_ORACLES)
