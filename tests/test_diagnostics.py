import math
import random

import numpy as np
import pytest
from tests.fixtures import WORKED, worked

from sourcelens.operators import ceiling, entropy, grain, guards, structure, tables


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0)[:4] if len(r) == 3 else r for r in rows], "source string, unit string, `group` string, weight double")


CROSSED = [(f"s{i}", f"u{i}{g}", g) for i in range(4) for g in "AB"]
NESTED = [(f"{g}{i}", f"u{g}{i}", g) for g in "AB" for i in range(4)]


def incidence(spark):
    return worked(spark).drop("weight", "laboratory").selectExpr("*", "1.0D as weight")


def test_worked_entropy(spark):
    r = entropy.frame_entropy(incidence(spark)).first()
    for k, v in WORKED.items():
        assert r[k] == pytest.approx(v, abs=1e-12)
    assert (r.n_sources, r.n_spanning_sources, r.n_nested_sources) == (43, 3, 40)


def test_worked_ceiling(spark):
    r = ceiling.balanced_accuracy_ceiling(tables.source_group_weight(incidence(spark))).first()
    assert r.exact == pytest.approx(0.537433155080214, abs=1e-12) and r.q_star == 0.5 and r.positive_group == "Cancer"


@pytest.mark.parametrize("rows,ratio,exact", [(CROSSED, 1.0, 1.0), (NESTED, 0.0, 0.5)])
def test_extremes(spark, rows, ratio, exact):
    f = frame(spark, rows)
    assert entropy.frame_entropy(f).first().ratio == pytest.approx(ratio, abs=1e-12)
    assert ceiling.balanced_accuracy_ceiling(tables.source_group_weight(f)).first().exact == pytest.approx(exact, abs=1e-12)


@pytest.mark.parametrize("scale", [1e-300, 1.0, 1e300])
def test_scale_of_weights(spark, scale):
    w = tables.source_group_weight(frame(spark, [(s, u, g, scale * (1 + (u == "u0A"))) for s, u, g in CROSSED]))
    one = tables.source_group_weight(frame(spark, [(s, u, g, 1.0 + (u == "u0A")) for s, u, g in CROSSED]))
    assert entropy.label_entropy(w).first().ratio == pytest.approx(entropy.label_entropy(one).first().ratio, rel=1e-9)
    assert guards.cramers_v(w).first().cramers_v == pytest.approx(guards.cramers_v(one).first().cramers_v, rel=1e-6)


def h(p):
    p = np.array([x for x in p if x > 0], float)
    p = p / p.sum()
    return float(-(p * np.log2(p)).sum())


def brute_ratio(x):
    n = x.sum(1)
    top = h(x.sum(0))
    return sum(n[i] / n.sum() * h(x[i]) for i in range(len(x)) if n[i] > 0) / top if top > 0 else None


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (9, 3)).astype(float)
    x[0] = [0, 0, 4]
    w = spark.createDataFrame([(f"s{i}", f"g{j}", float(x[i, j])) for i in range(9) for j in range(3)], "source string, `group` string, weight double")
    for r in entropy.leave_one_source_out(w).collect():
        want = brute_ratio(np.delete(x, int(r.source[1:]), 0))
        assert (r.ratio_without is None) == (want is None) and (want is None or r.ratio_without == pytest.approx(want, abs=1e-10))


def brute_ceiling(x):
    n = x.sum(1)
    live = n > 0
    p, c = x[live, 0] / n[live], n[live] / n.sum()
    pi = (c * p).sum()
    return max(0.5 * ((c * np.minimum(q, p)).sum() / pi + (c * np.minimum(1 - q, 1 - p)).sum() / (1 - pi)) for q in [0, 1, *p])


@pytest.mark.parametrize("seed", range(4))
def test_ceiling_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (25, 2)).astype(float)
    w = spark.createDataFrame([(f"s{i}", f"g{j}", float(x[i, j])) for i in range(25) for j in range(2)], "source string, `group` string, weight double")
    assert ceiling.balanced_accuracy_ceiling(w).first().exact == pytest.approx(brute_ceiling(x), abs=1e-12)
    with pytest.raises(KeyError):
        ceiling.ceiling_sensitivity(w, "nobody", [1.0])
    with pytest.raises(ValueError):
        ceiling.ceiling_sensitivity(w, "s1", [-1.0])


def test_ceiling_needs_two_groups(spark):
    with pytest.raises(ValueError):
        ceiling.balanced_accuracy_ceiling(tables.source_group_weight(frame(spark, [("s", "u", "g")])))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("force", ["direct", "rewrite"])
def test_pair_sharing_brute_force(spark, seed, force):
    rng = random.Random(seed)
    units = {f"u{i}": rng.choice("AB") for i in range(14)}
    rows = [(f"s{rng.randint(0, 6)}", u, units[u]) for u in units for _ in range(rng.randint(1, 4))]
    f = frame(spark, rows)
    of = {u: {s for s, v, _ in rows if v == u} for u in units}
    for r in structure.pair_sharing_by_group(f, force).collect():
        mine = sorted(u for u in units if units[u] == r.group)
        pairs = [(a, b) for a in mine for b in mine if a < b]
        assert r.n_pairs == len(pairs) and r.n_pairs_sharing == sum(bool(of[a] & of[b]) for a, b in pairs)
    c = structure.concentration(f, force).first()
    every = [(a, b) for a in units for b in units if a < b]
    assert c.n_pairs_sharing == sum(bool(of[a] & of[b]) for a, b in every)
    assert c.n_pairs_sharing_without_top == sum(bool((of[a] & of[b]) - {c.top_source}) for a, b in every)


def test_rank_is_not_the_shortcut(spark):
    r = guards.design_rank(frame(spark, [("S1", "u1", "A"), ("S1", "u2", "B"), ("S2", "u3", "C")])).first()
    assert (r.design_rank, r.design_columns, r.rank_deficient) == (3, 4, True)


@pytest.mark.parametrize("seed", range(5))
def test_rank_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 5)}", f"u{i}", f"g{rng.randint(0, 3)}") for i in range(rng.randint(3, 14))]
    s, g = sorted({r[0] for r in rows}), sorted({r[2] for r in rows})
    x = np.array([[r[0] == a for a in s] + [r[2] == b for b in g[1:]] for r in rows], float)
    r = guards.design_rank(frame(spark, rows)).first()
    assert r.design_rank == np.linalg.matrix_rank(x) and r.design_columns == x.shape[1]


def test_guards(spark):
    fires = {r.name: r.fires for r in guards.guard_report(frame(spark, NESTED)).collect()}
    assert all(fires[k] for k in ("cramers_v", "theils_u", "design_rank", "min_batch_size", "residual_entropy_ratio", "balanced_accuracy_ceiling"))
    fires = {r.name: r.fires for r in guards.guard_report(frame(spark, CROSSED)).collect()}
    assert not any(v for k, v in fires.items())


def test_grains(spark):
    f = worked(spark)
    got = {r.grain: r for r in grain.score_grains(f, ["source", "laboratory"], unit="unit", group="group").collect()}
    assert got["source"].ratio == pytest.approx(WORKED["ratio"], abs=1e-12) and got["laboratory"].n_sources == 2
    assert [r.grain for r in grain.ranked(grain.score_grains(f, {"one": "group", "lab": "laboratory"}, unit="unit", group="group")).collect()] == ["one", "lab"]
    with pytest.raises(TypeError):
        grain.grain_map("source")
    with pytest.raises(ValueError):
        grain.grain_map({})
    assert "undefined" in grain.declare_grain({"ratio": None, "grain": "x", "n_sources": 1, "n_rows": 1})


def test_bootstrap(spark):
    w = tables.source_group_weight(frame(spark, CROSSED + NESTED))
    a, b = entropy.bootstrap_ratio(w, 500, 3), entropy.bootstrap_ratio(w, 500, 3)
    assert (a.lower, a.upper) == (b.lower, b.upper) and 0 <= a.lower <= a.observed <= a.upper <= 1
    assert entropy.bootstrap_ratio(w, 500, 4).lower != a.lower or entropy.bootstrap_ratio(w, 500, 4).upper != a.upper
    x = np.array([[1, 1]] * 4 + [[1, 0]] * 4 + [[0, 1]] * 4, float)
    names = sorted([f"s{i}" for i in range(4)] + [f"{g}{i}" for g in "AB" for i in range(4)])
    x = np.array([[1, 1] if n[0] == "s" else [n[0] == "A", n[0] == "B"] for n in names], float)
    idx = np.random.default_rng(3).integers(0, 12, (500, 12))
    want = [brute_ratio(x[i]) for i in idx]
    got = [r.ratio for r in entropy.bootstrap_draws(w, 500, 3).orderBy("replicate").collect()]
    assert all((g is None and v is None) or g == pytest.approx(v, abs=1e-12) for g, v in zip(got, want))


def test_shannon():
    assert entropy.shannon_of([1, 1]) == 1 and math.isnan(entropy.shannon_of([0, 0]))
    with pytest.raises(ValueError):
        entropy.shannon_of([-1, 2])
