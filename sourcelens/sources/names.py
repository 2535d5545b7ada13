"""Designs from names of files and from sample tables with free column spellings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions.keys import KeySpec, as_spec, stripped
from sourcelens.operators.corpus import Corpus
from sourcelens.sources.audits import looks_like_prose

RESERVED = ("run", "n_tokens")


def cleaned(name: Column, strip_directory: bool = True, strip_extension: bool = True) -> Column:
    """The name without white space at its ends, directory and extension."""
    out = stripped(name)
    if strip_directory:
        out = F.regexp_extract(out, r"[^/\\]*$", 0)
    return F.regexp_replace(out, r"\.[A-Za-z0-9]{1,8}$", "") if strip_extension else out


def parse_run_names(names: DataFrame, schema: Mapping[str, int], *, column: str = "name", sep: str = "_", strip_directory: bool = True, strip_extension: bool = True, expected_tokens: int | None = None, allow_duplicates: bool = False, max_report: int = 10) -> DataFrame:
    """name, run, one column per field of schema (token places from 0, negative from the end), n_tokens.

    Names must have expected_tokens tokens: by default the most frequent number, of equally frequent ones the least.
    Names with another number, empty tokens and repeated names are errors that list examples.
    """
    if not schema or not sep:
        raise ValueError("a field and a separator are needed")
    for f, i in schema.items():
        if not isinstance(f, str) or not f.strip() or f in RESERVED:
            raise ValueError(f"{f!r} cannot be a field")
        if isinstance(i, bool) or not isinstance(i, int):
            raise TypeError(f"the place of {f!r} must be a whole number, not {i!r}")
    split = names.select(F.col(f"`{column}`").cast("string").alias("name")).withColumn("run", cleaned(F.col("name"), strip_directory, strip_extension))
    split = split.withColumn("t", F.split("run", re.escape(sep))).withColumn("n_tokens", F.size("t"))
    if expected_tokens is None:
        mode = split.groupBy("n_tokens").count().orderBy(F.desc("count"), "n_tokens").limit(1).collect()
        if not mode:
            raise ValueError("there are no names")
        expected_tokens = mode[0].n_tokens
    need = max(max(i + 1 if i >= 0 else -i for i in schema.values()), 1)
    if expected_tokens < need:
        raise ValueError(f"the fields need {need} tokens, but names have {expected_tokens}")
    off = split.where(F.col("n_tokens") != expected_tokens)
    if shown := [f"{r.name!r} ({r.n_tokens})" for r in off.orderBy("name").limit(max_report).collect()]:
        raise ValueError(f"{off.count()} names do not have {expected_tokens} tokens: {', '.join(shown)}")
    place = lambda i: i + 1 if i >= 0 else expected_tokens + i + 1
    out = split.select("name", "run", *[stripped(F.element_at("t", place(i))).alias(f) for f, i in schema.items()], "n_tokens")
    blank = out.agg(*[F.count_if(F.col(f"`{f}`") == "").alias(f) for f in schema]).first()
    if empty := [f for f in schema if blank[f]]:
        raise ValueError(f"tokens are empty for {empty}, as by a doubled separator")
    if not allow_duplicates:
        twice = [r.name for r in out.groupBy("name").count().where("count > 1").orderBy("name").limit(max_report).collect()]
        if twice:
            raise ValueError(f"names repeat: {twice}")
    return out


def from_filenames(names: DataFrame | Iterable[str], schema: Mapping[str, int], *, source_field: KeySpec, unit_field: KeySpec, group_field: KeySpec, weight_field: str | None = None, spark: SparkSession | None = None, corpus_name: str = "runs", dropna: bool = True, duplicates: str = "warn", hierarchy: Mapping[str, KeySpec] | None = None, **parsing) -> Corpus:
    """A corpus whose roles are tokens of names."""
    roles = {"source": source_field, "unit": unit_field, "group": group_field, **(hierarchy or {})}
    asked = [f for r, s in roles.items() for f in as_spec(s, r)] + ([weight_field] if weight_field else [])
    if absent := [f for f in asked if f not in schema]:
        raise KeyError(f"{absent} are no fields of the schema {sorted(schema)}")
    if not isinstance(names, DataFrame):
        names = (spark or SparkSession.getActiveSession()).createDataFrame([(str(n),) for n in names], "name string")
    parsed = parse_run_names(names, schema, **parsing)
    return Corpus.from_frame(parsed, source=source_field, unit=unit_field, group=group_field, weight=weight_field, name=corpus_name, dropna=dropna, duplicates=duplicates, hierarchy=hierarchy)


def resolved(columns: list[str], wanted: str, role: str) -> str:
    """The column with this name; else the only one that is equal without case and with single spaces."""
    if wanted in columns:
        return wanted
    fold = lambda c: " ".join(c.strip().lower().split())
    hits = [c for c in columns if fold(c) == fold(wanted)]
    if len(hits) != 1:
        raise KeyError(f"{role}: {wanted!r} is {'ambiguous: ' + str(hits) if hits else 'not among ' + str(columns[:20])}")
    return hits[0]


def from_sdrf(table: DataFrame, *, source_col: KeySpec, unit_col: KeySpec, group_col: KeySpec, weight_col: str | None = None, name: str = "sdrf", dropna: bool = True, duplicates: str = "warn", hierarchy: Mapping[str, KeySpec] | None = None) -> Corpus:
    """A corpus from a sample table; column names are matched exactly first, then without case and spacing."""
    fit = lambda spec, role: tuple(resolved(table.columns, c, role) for c in as_spec(spec, role))
    return Corpus.from_frame(
        table, source=fit(source_col, "source"), unit=fit(unit_col, "unit"), group=fit(group_col, "group"), weight=resolved(table.columns, weight_col, "weight") if weight_col else None, name=name, dropna=dropna,
        duplicates=duplicates, hierarchy={h: fit(s, h) for h, s in (hierarchy or {}).items()},
    )


def from_incidence_table(df: DataFrame, *, source: KeySpec, unit: KeySpec, group: KeySpec, weight: str | None = None, name: str = "supplement", duplicates: str = "raise", dropna: bool = True, hierarchy: Mapping[str, KeySpec] | None = None) -> Corpus:
    """A corpus from a published table: repeated keys are an error unless chosen otherwise, and a weight column of prose is refused."""
    if weight is not None and weight in df.columns and looks_like_prose(df, weight):
        raise ValueError(f"column {weight!r} holds texts with numbers in them, not weights")
    return Corpus.from_frame(df, source=source, unit=unit, group=group, weight=weight, name=name, duplicates=duplicates, dropna=dropna, hierarchy=hierarchy)
