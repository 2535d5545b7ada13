import math
from itertools import combinations

import numpy as np
import pytest

from sourcelens.operators import calibration, design, metrics

X = {"u1": [0.70, 0.20, 0.10], "u2": [0.60, 0.25, 0.15], "u3": [0.10, 0.20, 0.70], "u4": [0.15, 0.25, 0.60]}
S = np.array([[1, 0.8, 0.2, 0.1], [0.8, 1, 0.3, 0.2], [0.2, 0.3, 1, 0.6], [0.1, 0.2, 0.6, 1]])


def profiles(spark, x=X):
    return metrics.profiles(spark.createDataFrame([(k, v) for k, v in x.items()], "unit string, v array<double>"), "unit", "v")


def pairs(spark, s=S):
    n = len(s)
    return spark.createDataFrame([(f"u{i:02}", f"u{j:02}", float(1 - s[i, j]), float(s[i, j])) for i in range(n) for j in range(i + 1, n)], "i string, j string, distance double, similarity double")


def kl(a, b):
    return sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)


def clr(a):
    v = np.log(a)
    return v - v.mean()


BRUTE = {
    "pearson": lambda a, b: math.sqrt(1 - np.corrcoef(a, b)[0, 1]), "fisher_rao": lambda a, b: 2 * math.acos(min(1, np.sqrt(np.multiply(a, b)).sum())),
    "hellinger": lambda a, b: math.sqrt(1 - np.sqrt(np.multiply(a, b)).sum()), "jensen_shannon": lambda a, b: math.sqrt((kl(a, np.add(a, b) / 2) + kl(b, np.add(a, b) / 2)) / 2),
    "euclidean": lambda a, b: float(np.linalg.norm(np.subtract(a, b))), "aitchison": lambda a, b: float(np.linalg.norm(clr(a) - clr(b))),
}


@pytest.mark.parametrize("name", sorted(BRUTE))
@pytest.mark.parametrize("block", [1, 500])
def test_geometries(spark, monkeypatch, name, block):
    monkeypatch.setattr(metrics, "BLOCK_UNITS", block)
    got = {(r.i, r.j): r.distance for r in metrics.METRICS[name](profiles(spark)).collect()}
    assert got == {(a, b): pytest.approx(BRUTE[name](X[a], X[b]), abs=1e-9) for a, b in combinations(X, 2)}


def test_blocks(spark):
    x = spark.createDataFrame([("a", [[0.5, 0.5], [0.9, 0.1]]), ("b", [[0.2, 0.8], [0.9, 0.1]])], "unit string, v array<array<double>>")
    p = metrics.profiles(x, "unit", "v")
    one = BRUTE["hellinger"]([0.5, 0.5], [0.2, 0.8])
    assert metrics.hellinger(p).first().distance == pytest.approx(math.sqrt(one**2 / 2))
    assert metrics.euclidean(p).first().distance == pytest.approx(math.sqrt(0.18 / 2))


def test_refusals(spark):
    for name, x in (("hellinger", {"a": [1.2, -0.2], "b": [0.5, 0.5]}), ("hellinger", {"a": [0.4, 0.4], "b": [0.5, 0.5]}), ("pearson", {"a": [1.0, 1.0], "b": [0.5, 0.4]}),
                    ("aitchison", {"a": [1.0, 0.0], "b": [0.5, 0.5]}), ("euclidean", {"a": [1.0, float("nan")], "b": [0.5, 0.5]}), ("euclidean", {"a": [1.0, 2.0]}), ("euclidean", {"a": [1.0], "b": [0.5, 0.5]})):
        with pytest.raises(ValueError):
            metrics.METRICS[name](profiles(spark, x))
    with pytest.raises(KeyError):
        metrics.resolve(["nope"])
    with pytest.raises(ValueError):
        metrics.aitchison(profiles(spark), eps=-1)


def test_agreement_and_result(spark):
    got = {(r.a, r.b): r.spearman for r in metrics.metric_agreement(profiles(spark), ["hellinger", "fisher_rao"]).collect()}
    assert got["hellinger", "fisher_rao"] == pytest.approx(1) and len(got) == 4
    m = metrics.measure(profiles(spark), "aitchison", eps=0.1).check()
    assert m.geometry == "aitchison(eps=0.1)" and m.as_frame().loc["u1", "u3"] == m.as_frame().loc["u3", "u1"]
    same = {"a": [0.5, 0.5], "b": [0.5, 0.5], "c": [0.5, 0.5]}
    assert metrics.metric_agreement(profiles(spark, same), ["euclidean"]).first().spearman is None


def test_gap(spark):
    p = pairs(spark)
    assert calibration.dispersion_gap(p, ["u00", "u01"], ["u02", "u03"]).first().gap == pytest.approx(0.2)
    assert calibration.dispersion_gap(p, ["u02", "u03"], ["u00", "u01"], signed=True).first().gap == pytest.approx(-0.2)
    assert calibration.dispersion_gap(p, ["u00"], ["u02", "u03"]).first().gap is None
    with pytest.raises(ValueError):
        calibration.dispersion_gap(p, ["u00", "u01"], ["u01", "u03"])


@pytest.mark.parametrize("n,k", [(7, 3), (8, 4), (6, 2)])
def test_enumeration(n, k):
    masks = calibration.partition_masks(np.arange(calibration.n_partitions(n, k)), n, k)
    got = {frozenset(np.flatnonzero(m)) for m in masks}
    want = {frozenset(c) for c in combinations(range(n), k) if 2 * k != n or 0 in c}
    assert got == want and len(masks) == len(want)
    assert calibration.n_partitions(4, 2) == 3


def test_split_null(spark):
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 1, (9, 9))
    s = (s + s.T) / 2
    r = calibration.arbitrary_split_null(pairs(spark, s), 4, observed=0.1, keep_values=True)

    def gap(a):
        b = [i for i in range(9) if i not in a]
        mean = lambda x: np.mean([s[i, j] for i, j in combinations(x, 2)])
        return abs(mean(a) - mean(b))

    want = sorted(gap(c) for c in combinations(range(9), 4))
    assert sorted(r.values) == pytest.approx(want) and r.maximum == pytest.approx(want[-1]) and r.exhaustive
    assert r.p_value(0.1) == sum(v >= 0.1 for v in want) / len(want) and r.population_p_is_exact(0.1)
    lean = calibration.arbitrary_split_null(pairs(spark, s), 4, bins=50)
    low, high = lean.p_value_bounds(0.1)
    assert low <= r.p_value(0.1) <= high and abs(lean.median - np.median(want)) <= 2 * lean.width
    a = calibration.arbitrary_split_null(pairs(spark, s), 4, exhaustive=False, samples=20, seed=2, max_exhaustive=10)
    assert a.n_evaluated == 20 and not a.exhaustive and a.maximum <= r.maximum + 1e-12
    assert a.maximum == calibration.arbitrary_split_null(pairs(spark, s), 4, exhaustive=False, samples=20, seed=2, max_exhaustive=10).maximum
    with pytest.raises(ValueError):
        calibration.arbitrary_split_null(pairs(spark, s), 8)


def test_k_diagnostic(spark):
    member = spark.createDataFrame([("u00", "a"), ("u01", "a"), ("u02", "b"), ("u03", "b")], "unit string, side string")
    r = calibration.k_diagnostic(pairs(spark), member, calibration.KBreakEven(0.5, 1.5, 2, 2)).first()
    assert r.k is None and r.verdict == "undetermined"
    with pytest.raises(ValueError):
        calibration.KBreakEven(2, 1, 2, 2)
    with pytest.raises(ValueError):
        calibration.k_diagnostic(pairs(spark), member, calibration.KBreakEven(0.5, 1.5, 3, 2))


def test_median_split():
    assert calibration.median_split_indices([1, 2, 3, 4]) == ([(2, 3)], True)
    sides, everything = calibration.median_split_indices([1, 2, 2, 2], 2)
    assert everything and sorted(sides) == [(1, 2), (1, 3), (2, 3)]
    some, everything = calibration.median_split_indices([1] * 30, 15, max_variants=10)
    assert len(some) == 10 and not everything


@pytest.mark.parametrize("crossing", [0, 0.25, 0.5, 1])
@pytest.mark.parametrize("sizes", [None, [10, 8, 6]])
def test_simulation(crossing, sizes):
    for seed in range(5):
        c = design.simulate(24, 12, crossing, sizes=sizes, seed=seed, dispersion=0.5)
        assert len(set(c.unit)) == 24 and len(set(c.source)) == 12 and len(set(zip(c.source, c.unit))) == len(c.source)
        crossed = sum(len({g for s, g in zip(c.source, c.group) if s == k}) > 1 for k in range(12))
        assert crossed == c.n_crossing == round(crossing * 12) and c.mass.mean() == pytest.approx(1)
        again = design.simulate(24, 12, crossing, sizes=sizes, seed=seed, dispersion=0.5)
        assert (again.mass == c.mass).all()
    with pytest.raises(ValueError):
        design.simulate(24, 12, 2)


def test_scores_agree_with_the_engine(spark):
    from sourcelens.operators import ceiling, entropy, tables

    c = design.score(design.simulate(30, 10, 0.4, seed=3, dispersion=1))
    w = tables.source_group_weight(design.simulated_frame(spark, 30, 10, 0.4, seed=3, dispersion=1))
    assert c["ratio"] == pytest.approx(entropy.label_entropy(w).first().ratio) and c["ceiling"] == pytest.approx(ceiling.balanced_accuracy_ceiling(w).first().exact)


def test_curves(spark):
    r = {x.crossing_fraction: x for x in design.design_curve(spark, 20, 10, [0, 0.5, 1], replicates=20, seed=1).collect()}
    assert r[0].ratio_mean == 0 and r[0].ceiling_mean == pytest.approx(0.5) and r[0].frac_ratio_zero == 1 and r[0.5].ratio_mean < r[1].ratio_mean
    m = design.minimum_viable_crossing(spark, 0.6, (20,), (10,), replicates=10, crossing_grid=[0, 0.5, 1]).first()
    assert m.min_crossing_fraction in (0.5, 1.0) and m.achieved_ceiling >= 0.6
    assert design.minimum_viable_crossing(spark, 1.0, (20,), (10,), replicates=5, crossing_grid=[0, 0.1]).first().min_crossing_fraction is None
    e = design.simulated_ceiling_envelope(spark, [0, 0.5, 1], replicates=10, min_count=1).collect()
    assert len(e) == 2 and sum(x.n for x in e) == 20
    o = design.operating_characteristic(spark, [0.2, 0.8], n_designs=40).orderBy("threshold").collect()
    assert o[0].n_flagged <= o[1].n_flagged and o[0].n_designs == o[1].n_designs
    b = design.estimator_behavior(spark, 0.4, (10,), (20,), replicates=10, reference=(40, 40), calibration_points=6, calibration_rep=3, reference_rep=5).first()
    assert abs(b.reference_ratio - 0.4) < 0.15 and b.rmse >= abs(b.bias) - 1e-12
    for bad in (lambda: design.design_curve(spark, 20, 10, []), lambda: design.minimum_viable_crossing(spark, 0.4), lambda: design.statistic("x", "p200")):
        with pytest.raises(ValueError):
            bad()
