"""Geometries and nulls at sizes where pairs are not to be shuffled, collected or held."""

import time
from itertools import combinations

import numpy as np
import pytest
from tests.oracle import same

from sourcelens.operators import calibration, metrics
from sourcelens.plans import catalog


def copied_events(spark, path, users=60, copies=3):
    """Users in copies, so that profiles repeat."""
    rows = [(1000 * c + u, "abc"[(u * k) % 3]) for c in range(copies) for u in range(users) for k in range(1 + u % 7)]
    spark.createDataFrame(rows, "user_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["euclidean", "aitchison", "fisher_rao", "hellinger", "jensen_shannon"])
def test_blocks_are_few(spark, monkeypatch, tmp_path, name):
    """However many blocks the units would fill, a unit is shuffled BLOCKS + 1 times at most, as a part of a packed row."""
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 1)
    monkeypatch.setattr(metrics, "BLOCKS", 4)
    d = copied_events(spark, tmp_path)
    df = catalog.queries()[name](spark, d)
    assert same(df, catalog.oracle_sql()[name], d, {"events": spark.read.parquet(f"{d}/events.parquet").toArrow()}) == 180 * 179 // 2


def test_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 1)
    p = metrics.profiles(spark.range(100).selectExpr("id", "array(id * 1.0, 1.0) AS v"), "id", "v")
    blocks, k, begins = metrics._packed(p)
    assert k == metrics.BLOCKS and blocks.count() <= k and begins == [0]
    assert metrics.round_half_up(np.array([0.5000005, -0.0, -1.25]), 1).tolist() == [0.5, 0.0, -1.3]


def test_sweep_counts_copies(spark, tmp_path):
    d = copied_events(spark, tmp_path)
    tables = {"events": spark.read.parquet(f"{d}/events.parquet").toArrow()}
    same(catalog.queries()["aitchison_sweep"](spark, d), catalog.oracle_sql()["aitchison_sweep"], d, tables)
    p = metrics.profiles(spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.5, 0.5]), ("c", [0.25, 0.75])], "unit string, v array<double>"), "unit", "v")
    pairs = metrics.class_pairs(metrics.log_ratios(p), metrics._squares).collect()
    assert sorted((r.i, r.j, r.n) for r in pairs) == [("a", "a", 1), ("a", "c", 2)] or sorted((r.j, r.i, r.n) for r in pairs) == [("a", "a", 1), ("a", "c", 2)]


def test_agreement_counts_copies(spark, monkeypatch, tmp_path):
    """By pairs of different profiles the agreement is that of all pairs."""
    d = copied_events(spark, tmp_path)
    by_class = {(r.a, r.b): r.spearman for r in catalog.queries()["metric_agreement"](spark, d).collect()}
    every = {n: (lambda p, n=n: metrics.METRICS[n](p)) for n in ("euclidean", "fisher_rao", "hellinger", "jensen_shannon")}
    from sourcelens.plans.feature_queries import event_shares

    plain = {(r.a, r.b): r.spearman for r in metrics.metric_agreement(event_shares(spark, d), every).collect()}
    assert len(plain) == 16 and by_class == {k: pytest.approx(v, abs=1e-3) for k, v in plain.items()}


def vectors(spark, n=40, width=16):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width)) + 1
    p = metrics.profiles(spark.createDataFrame([(f"u{k:02}", v.tolist()) for k, v in enumerate(x)], "unit string, v array<double>"), "unit", "v")
    member = spark.createDataFrame([(f"u{k:02}", "a" if k < 15 else "b") for k in range(n)], "unit string, side string")
    return x, p, member


def test_gaps_from_vectors(spark):
    """Sides of vectors give the gap of all their pairs without a pair."""
    x, p, member = vectors(spark)
    r = np.corrcoef(x)
    mean = lambda s: np.mean([r[i, j] for i, j in combinations(s, 2)])
    want = mean(range(15)) - mean(range(15, 40))
    u = metrics.unit_vectors(p)
    assert calibration.gap_of(u, member, signed=True).first().gap == pytest.approx(want, abs=1e-12)
    assert calibration.named_split(u, member.withColumnRenamed("side", "label"), "a", "b").first().gap == pytest.approx(want, abs=1e-12)
    assert calibration.gap_of(u, member.where("unit = 'u00' or side = 'b'")).first().gap is None


def test_wide_vectors_are_made_once(spark):
    """Lengths and means are computed once a row, not for every cell."""
    rng = np.random.default_rng(1)
    rows = [(str(k), v.tolist()) for k, v in enumerate(rng.normal(size=(40, 600)))]
    p = metrics.profiles(spark.createDataFrame(rows, "unit string, v array<double>"), "unit", "v")
    began = time.time()
    assert metrics.unit_vectors(p).count() == 40 and len(metrics.unit_vectors(p).collect()) == 40
    assert time.time() - began < 60


def test_centrality_from_vectors(spark):
    _, p, member = vectors(spark)
    u = metrics.unit_vectors(p)
    even = calibration.KBreakEven(0.9, 1.1, 15, 25)
    got, want = calibration.k_diagnostic(u, member, even).first(), calibration.k_diagnostic(metrics.pearson(p), member, even).first()
    assert (got.sd_a, got.sd_b, got.k) == pytest.approx((want.sd_a, want.sd_b, want.k), abs=1e-12) and got.verdict == want.verdict


def test_null_beyond_a_matrix(spark):
    """More units than a driver's matrix holds; the gaps of all pairs."""
    _, p, _ = vectors(spark, 5200, 3)
    u = metrics.unit_vectors(p)
    stats, plan = calibration.null_statistics(u, 2600, samples=4, seed=1)
    got = [r.gap for r in stats.orderBy("rank").collect()]
    _, v = calibration.vector_matrix(u)
    s = v @ v.T
    np.fill_diagonal(s, 0)
    assert plan["n"] == 5200 and got == pytest.approx(calibration.gap_batch(s, calibration.drawn_masks(np.arange(4), 5200, 2600, 1)).tolist(), abs=1e-12)


def test_histogram_from_vectors(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 7)
    _, p, _ = vectors(spark, 30)
    got, want = (calibration.arbitrary_split_null(x, 15, bins=20, observed=0.05, samples=200) for x in (metrics.unit_vectors(p), metrics.pearson(p)))
    assert got.histogram == want.histogram and got.width == pytest.approx(want.width) and got.registered == want.registered


def test_median_split_is_written_by_tasks(spark):
    """Thousands of tied values: a variant is a row of bits on the driver."""
    v = [3.0] * 5 + [2.0] * 6000 + [1.0] * 5
    above, tied, masks, whole = calibration._median_split_picks(v, None, 40, 0)
    assert len(above) == 5 and len(masks) == 40 and not whole and {len(m) for m in masks} == {750}
    rows = calibration.median_split_table(spark, v, max_variants=40).orderBy("variant").collect()
    want, _ = calibration.median_split_indices(v, max_variants=40)
    assert [tuple(r.side_a) for r in rows] == want == sorted(want)
    assert calibration.median_split_indices([2, 1, 1, 1])[0] == [(0, 1), (0, 2), (0, 3)]


@pytest.mark.parametrize("block", [3, 1000])
def test_shared_pairs_by_blocks(spark, monkeypatch, block):
    """Units of one source and of several, in sources of many blocks."""
    from sourcelens.operators import structure

    monkeypatch.setattr(structure, "BLOCK_UNITS", block)
    of = {f"u{k:02}": {f"s{k % 3}"} | ({"s0", f"s{k % 2}"} if k % 4 == 0 else set()) for k in range(30)}
    frame = spark.createDataFrame([(s, u) for u, x in of.items() for s in x for _ in range(2)], "source string, unit string")
    got = structure.shared_source_pairs(frame)
    want = {(a, b): len(of[a] & of[b]) for a, b in combinations(of, 2) if of[a] & of[b]}
    rows = got.collect()
    assert {(r.unit_a, r.unit_b): r.n_shared for r in rows} == want and len(rows) == len(want)
    # pairs of units with one source are not aggregated
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


@pytest.mark.parametrize("ranked", [None, 0])
def test_agreement_of_blocks(spark, monkeypatch, ranked):
    """Pairs inside a block meet in every geometry, whatever the order of their units; ranges of values instead of values; no pair leaves its task."""
    from itertools import product

    import pandas as pd

    if ranked is not None:
        monkeypatch.setattr(metrics, "RANKED", ranked)
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 20)
    x = np.random.default_rng(5).dirichlet([2, 3, 4, 5], 70)
    x = np.concatenate([x, x[:10]])
    p = metrics.profiles(spark.createDataFrame([(f"u{k:02}", v.tolist()) for k, v in enumerate(x)], "unit string, v array<double>").repartition(7), "unit", "v")
    i, j = np.triu_indices(len(x), 1)
    mid = (x[i] + x[j]) / 2
    overlap = np.minimum(np.sqrt(x[i] * x[j]).sum(1), 1)
    want = {
        "euclidean": np.sqrt(np.square(x[i] - x[j]).sum(1)), "hellinger": np.sqrt(1 - overlap), "pearson": np.sqrt(1 - np.array([np.corrcoef(x[a], x[b])[0, 1] for a, b in zip(i, j)]).clip(-1, 1)),
        "jensen_shannon": np.sqrt(np.maximum((x[i] * np.log2(x[i] / mid) + x[j] * np.log2(x[j] / mid)).sum(1) / 2, 0)),
    }
    ranks = {n: pd.Series(np.where(v < 1e-6, 0, v)).rank() for n, v in want.items()}
    for which in ("distance", "similarity"):
        got = {(r.a, r.b): r.spearman for r in metrics.metric_agreement(p, list(want), which).collect()}
        assert got == {(a, b): pytest.approx(np.corrcoef(ranks[a], ranks[b])[0, 1], abs=1e-6 if ranked is None else 1e-5) for a, b in product(want, want)}


@pytest.mark.parametrize("name", ["aitchison", "euclidean", "jensen_shannon", "pearson", "fisher_rao", "hellinger"])
def test_pairs_leave_in_runs(spark, monkeypatch, name):
    """Every pair once, equal values one after the other, so that files hold runs; a profile of most units is dealt to several blocks."""
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 40)
    monkeypatch.setattr(metrics, "SORTED_PAIRS", 3000)
    kinds = [[0.5, 0.3, 0.2], [0.1, 0.2, 0.7], [0.3, 0.6, 0.1]]
    rows = [(f"u{k:03}", kinds[0 if k % 4 else 1 + k // 4 % 2]) for k in range(120)]
    p = metrics.profiles(spark.createDataFrame(rows, "unit string, v array<double>"), "unit", "v")
    t = metrics.METRICS[name](p, digits=6).toArrow()
    d = t["distance"].to_numpy()
    assert len(set(zip(t["i"].to_pylist(), t["j"].to_pylist()))) == t.num_rows == 120 * 119 // 2 and all(a < b for a, b in zip(t["i"].to_pylist(), t["j"].to_pylist()))
    # 6 values in 6 cells of up to 3000 pairs at once
    assert (np.diff(d) != 0).sum() < 60
    blocks, k, _ = metrics._packed(p, alike=True)
    sizes = [len(r.units) for r in blocks.collect()]
    assert k == 3 and sum(sizes) == 120 and max(sizes) < 100


def test_profiles_in_single_precision(spark, monkeypatch):
    """Profiles of single precision are shuffled as such, others are not; correlations are those of double precision."""
    monkeypatch.setattr(metrics, "BLOCK_UNITS", 7)
    shipped = []
    packed = metrics._packed
    monkeypatch.setattr(metrics, "_packed", lambda p, *a, **k: shipped.append(p.schema["x"].dataType.simpleString()) or packed(p, *a, **k))
    x, _, _ = vectors(spark, 20)
    for v, kind in ((x.astype(np.float32).astype(float), "array<array<float>>"), (x, "array<array<double>>")):
        p = metrics.profiles(spark.createDataFrame([(f"u{k:02}", r.tolist()) for k, r in enumerate(v)], "unit string, v array<double>"), "unit", "v")
        want = np.corrcoef(v)
        rows = metrics.pearson(p).collect()
        assert shipped.pop() == kind and len(rows) == 190
        assert all(abs(r.similarity - want[int(r.i[1:]), int(r.j[1:])]) < 1e-12 for r in rows)
