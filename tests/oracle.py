"""Runs a query's SQL in DuckDB over the same Parquet tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def run_sql(sql, sf_dir=SF_DIR, tables=None):
    """Columns and rows of sql; tables: Arrow tables that stand for the files."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if tables and t in tables:
            con.register(t, tables[t])
        elif os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, sql, sf_dir=SF_DIR, tables=None):
    """Asserts that df and sql have the same columns and the same rows, in any order."""
    cols, want = run_sql(sql, sf_dir, tables)
    order = sorted(cols)
    assert sorted(df.columns) == order, (sorted(df.columns), order)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    at = [cols.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in at) for r in want]
    key = lambda r: [(v is None, str(type(v)) if v is not None and not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (order, a, b)
    return len(got)
