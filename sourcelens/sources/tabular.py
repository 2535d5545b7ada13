"""Metadata files: strict CSV and TSV, tolerant delimited tables, Excel, long frames."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from os import PathLike
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sourcelens.functions.keys import KeySpec
from sourcelens.operators.corpus import POSITION, Corpus

#: Delimiters that are tried, in order.
DELIMITERS = ("\t", ",", ";", "|")


class MetadataReadError(ValueError):
    """A metadata file breaks a rule of the strict format."""


def _records(text: str, delimiter: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows; every rule of the strict format is checked."""
    if "\x00" in text:
        raise MetadataReadError("the file holds NUL characters")
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))
    except csv.Error as e:
        raise MetadataReadError(f"the file is malformed: {e}") from e
    if not rows or not any(c.strip() for c in rows[0]):
        raise MetadataReadError("the file has no header")
    header = rows[0]
    if any(not c.strip() for c in header) or len(set(header)) != len(header):
        raise MetadataReadError("column names must be unique and not blank")
    if len(rows) == 1:
        raise MetadataReadError("the file has a header only")
    for i, r in enumerate(rows[1:], 2):
        if not r or not any(c.strip() for c in r):
            raise MetadataReadError(f"record {i} is blank")
        if len(r) != len(header):
            raise MetadataReadError(f"record {i} has {len(r)} fields; the header has {len(header)}")
    return header, rows[1:]


def _frame(spark: SparkSession, header: list[str], rows: list[list[str]]) -> DataFrame:
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*header])
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, f"{schema}, {POSITION} long")


def read_metadata_with_fingerprint(spark: SparkSession, path: str | PathLike[str], format: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """All columns as text with row_position, and name, SHA-256, size and format of the same bytes."""
    p = Path(path)
    kind = format or p.suffix.lower().lstrip(".")
    if kind not in ("csv", "tsv"):
        raise MetadataReadError(f"the format must be csv or tsv, not {kind!r}")
    raw = p.read_bytes()
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeError as e:
        raise MetadataReadError("the file is not UTF-8") from e
    delimiter = "," if kind == "csv" else "\t"
    header, rows = _records(text, delimiter)
    if POSITION in header:
        raise MetadataReadError(f"the column name {POSITION!r} is reserved")
    info = {"kind": "file", "name": p.name, "sha256": hashlib.sha256(raw).hexdigest(), "size_bytes": len(raw), "format": kind, "encoding": "utf-8-sig", "delimiter": delimiter}
    return _frame(spark, header, rows), info


def read_metadata(spark: SparkSession, path: str | PathLike[str], format: str | None = None) -> DataFrame:
    return read_metadata_with_fingerprint(spark, path, format)[0]


def sniff_separator(path: str | PathLike[str], encoding: str = "utf-8-sig", n_chars: int = 65_536) -> str | None:
    """The delimiter of the file's beginning: as the csv module guesses, else one that all first lines hold equally often."""
    with open(path, encoding=encoding, errors="replace", newline="") as f:
        sample = f.read(n_chars)
    sample = sample[: sample.rfind("\n")] if "\n" in sample else sample
    if not sample.strip():
        return None
    try:
        guess = csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
        if guess in DELIMITERS:
            return guess
    except csv.Error:
        pass
    lines = [x for x in sample.splitlines() if x.strip()][:5]
    steady = {d: lines[0].count(d) for d in DELIMITERS if lines and len({x.count(d) for x in lines}) == 1 and d in lines[0]}
    return max(steady, key=steady.get) if steady else None


def read_table(spark: SparkSession, path: str | PathLike[str], *, sep: str | None = None, encoding: str = "utf-8-sig") -> DataFrame:
    """A delimited file with all columns as text: the given delimiter, else the sniffed one, else tab.

    Names lose BOM and white space. A file that yields one column is an error,
    as its delimiter was not found. Spark reads the file, so it may be large.
    """
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no file {p}")
    tried = [sep] if sep is not None else list(dict.fromkeys([sniff_separator(p, encoding) or ",", "\t"]))
    for d in tried:
        df = spark.read.csv(str(p), sep=d, header=True, multiLine=True, escape='"', encoding=re.sub("-sig$", "", encoding), inferSchema=False, mode="PERMISSIVE")
        if len(df.columns) > 1:
            return df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])
    raise ValueError(f"{p.name} has one column only with {' and '.join(map(repr, tried))}; name its delimiter")


def from_csv(spark: SparkSession, path: str | PathLike[str], *, source: KeySpec, unit: KeySpec, group: KeySpec, name: str | None = None, sep: str | None = None, encoding: str = "utf-8-sig", **roles) -> Corpus:
    """A corpus from a delimited file."""
    return Corpus.from_frame(read_table(spark, path, sep=sep, encoding=encoding), source=source, unit=unit, group=group, name=name or Path(path).stem, **roles)


def from_excel(spark: SparkSession, path: str | PathLike[str], *, sheet: str | int = 0, header: int = 0, source: KeySpec, unit: KeySpec, group: KeySpec, name: str | None = None, **roles) -> Corpus:
    """A corpus from one sheet; needs an Excel engine for pandas."""
    import pandas as pd

    try:
        df = pd.read_excel(path, sheet_name=sheet, header=header, dtype=str)
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl (or xlrd for .xls)") from e
    if not isinstance(df, pd.DataFrame):
        raise TypeError("one sheet at a time")
    df.columns = [str(c).strip().lstrip("﻿").strip() for c in df.columns]
    rows = [tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False, name=None)]
    frame = _frame(spark, list(df.columns), [list(r) for r in rows])
    return Corpus.from_frame(frame, source=source, unit=unit, group=group, name=name or f"{Path(path).stem}[{sheet}]", **roles)


def from_long(df: DataFrame, *, source: KeySpec = "source", unit: KeySpec = "unit", group: KeySpec = "group", **roles) -> Corpus:
    """A corpus from a DataFrame that is long already."""
    return Corpus.from_frame(df, source=source, unit=unit, group=group, **roles)


