import hashlib
import os

import numpy as np
import pytest
from tests.oracle import SF_DIR, same

from sourcelens.llm import exact


def test_oracle(spark):
    assert same(exact.op3_exact(spark, SF_DIR), exact.ORACLE) == 1000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 20000])
def test_perfect_hash(n):
    keys = [hashlib.sha256(f"{n}:{i}".encode()).digest() for i in range(n)]
    sizes, bits, slot = exact.build(b"".join(keys))
    assert sorted(slot) == list(range(n))  # minimal and perfect
    assert np.array_equal(exact.slots(sizes, bits, b"".join(keys)), slot)
    strange = exact.slots(sizes, bits, os.urandom(32 * 50))
    assert ((strange >= -1) & (strange < max(n, 1))).all()


ROWS = [(1, "Ab"), (2, "aB"), (2, "ab"), (None, "AB"), (3, None), (4, ""), (None, "É"), (None, "É"), (5, "é"), (6, "x" * 300000), (7, "X" * 300000), (1, " ab")]


def brute(rows):
    groups = {}
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("below", [None, -1, 3, 100])
@pytest.mark.parametrize("shard", [2, 1000])
def test_small_rows(spark, monkeypatch, below, shard):
    monkeypatch.setattr(exact, "SHARD_KEYS", shard)
    docs = spark.createDataFrame([(*r, 1, True) for r in ROWS], "doc_id long, text string, keep_id int, digest boolean")
    got = exact.exact_dedup(docs, below).collect()
    want, n = brute(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert exact.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nonmembers_and_members(spark):
    rows = spark.createDataFrame([(i, f"t{i % 6}") for i in range(12)], "doc_id long, text string")
    base = rows.selectExpr("doc_id as id").withColumn("digest", exact.digest(exact.F.concat(exact.F.lit("t"), exact.F.col("id") % 6))).withColumn("row", exact.F.col("id"))
    index = exact.build_index(exact.groups(base.where("id < 3")), 2)
    got = exact.look_up(exact.groups(base.where("id >= 3")), index, 2).collect()
    assert sorted((r.win_id, r.n, r.member) for r in got) == [(6, 2, True), (7, 2, True), (8, 2, True), (9, 2, False), (10, 2, False), (11, 2, False)]
