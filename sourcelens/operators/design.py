"""Prospective design simulation: synthetic corpora, scored in parallel.

Every replicate has an addressed seed, so replicates are rows of a DataFrame
and tasks simulate and score their own; results do not depend on the number of
tasks. Summaries are ordinary aggregations.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAX_SEED = 2**31 - 1
_DRAW = "cell long, rep long, n_units int, n_sources int, crossing double, seed long, extra_rows double, dispersion double, sizes array<int>"
_SCORE = "cell long, rep long, ratio double, ceiling double, h_group double, h_group_given_source double, n_rows long, n_spanning long"


@dataclass(frozen=True)
class Simulated:
    """Rows of a synthetic corpus as index arrays; masses have mean 1."""

    source: np.ndarray
    unit: np.ndarray
    group: np.ndarray
    mass: np.ndarray
    groups: tuple[str, ...]
    n_crossing: int


def group_sizes(n_units: int, sizes: Sequence[int] | Mapping[str, int] | None = None) -> dict[str, int]:
    """Units per group: halves A and B by default; a sequence names its groups A to Z, then G26 and so on."""
    given = [n_units // 2, n_units - n_units // 2] if sizes is None else sizes
    if not isinstance(given, Mapping):
        letters = string.ascii_uppercase
        given = {(letters[i] if i < len(letters) else f"G{i:02d}"): v for i, v in enumerate(given)}
    out = {str(name): int(n) for name, n in given.items()}
    if len(out) < 2 or any(n < 1 for n in out.values()) or sum(out.values()) != n_units:
        raise ValueError(f"groups {out} must be two or more, not empty, and hold {n_units} units together")
    return out


def allocate(n: int, sizes: np.ndarray) -> np.ndarray:
    """Group of each of n nested sources: in proportion to the sizes, one per group at least if there are enough.

    The groups bid for one source after another: first each for its first, if
    all can have one, then that with the largest size per source it would have.
    """
    sizes = np.asarray(sizes, float)
    every = n >= len(sizes)
    # the bids of a group fall with the sources it has, so the n highest of all are what bidding in turn gives
    bids = sizes[:, None] / (np.arange(n) + 0.5)
    if every and n:
        bids[:, 0] = np.inf
    order = np.argsort(-bids, axis=None, kind="stable")[:n]
    return np.sort(order // max(n, 1))


def simulate(n_units: int, n_sources: int, crossing: float, *, sizes=None, seed: int = 0, extra_rows: float = 1.0, dispersion: float = 0.0) -> Simulated:
    """A corpus with exactly round(crossing * n_sources) sources in two groups, every unit and every source present.

    A table of sources by groups says which units a source may hold. Every
    allowed pair of them gets one unit drawn at random; a unit that no pair drew
    goes to a random source that may hold it; Poisson many rows more per source
    are drawn from all units that it may hold (any, if it crosses). Repeats go.
    With dispersion, rows weigh lognormal masses of mean 1.
    """
    limits = {"units": n_units >= 2, "sources": n_sources >= 1, "crossing, which lies in [0, 1]": 0 <= crossing <= 1, "extra_rows": extra_rows >= 0, "dispersion": dispersion >= 0}
    if wrong := [name for name, ok in limits.items() if not ok]:
        raise ValueError(f"out of range: {', '.join(wrong)}")
    named = group_sizes(n_units, sizes)
    size = np.fromiter(named.values(), int)
    of_unit = np.repeat(np.arange(len(size)), size)
    rng = np.random.default_rng(seed)
    n_cross = min(round(crossing * n_sources), n_sources)

    # the two groups of a crossing source: those with the least exponential waiting times, which is a draw by size without return
    waits = rng.exponential(size=(n_cross, len(size))) / size
    home = allocate(n_sources - n_cross, size)
    allowed = np.zeros((n_sources, len(size)), bool)
    np.put_along_axis(allowed[:n_cross], np.argsort(waits, 1)[:, :2], True, 1)
    allowed[np.arange(n_cross, n_sources), home] = True
    if not allowed.any(0).all():
        raise ValueError("a group has no source that could hold its units; use more sources or more crossing")

    def units_of(group: np.ndarray) -> np.ndarray:
        return (np.cumsum(size) - size)[group] + (rng.random(len(group)) * size[group]).astype(int)

    source, group = np.nonzero(allowed)
    unit = units_of(group)
    bare = np.setdiff1d(np.arange(n_units), unit)
    holders = allowed[:, of_unit[bare]]  # sources that may hold each bare unit; a random key each, the largest takes it
    taker = np.where(holders, rng.random(holders.shape), -1).argmax(0) if len(bare) else np.zeros(0, int)
    more = np.repeat(np.arange(n_sources), rng.poisson(extra_rows, n_sources))
    crosses = more < n_cross
    drawn = np.where(crosses, rng.integers(0, n_units, len(more)), 0)
    drawn[~crosses] = units_of(home[more[~crosses] - n_cross])

    rows = np.unique(np.stack([np.concatenate([source, taker, more]), np.concatenate([unit, bare, drawn])]), axis=1)
    mass = rng.lognormal(0, dispersion, rows.shape[1]) if dispersion > 0 else np.ones(rows.shape[1])
    out = Simulated(rows[0], rows[1], of_unit[rows[1]], mass / mass.mean(), tuple(named), n_cross)
    _verify(out, n_units, n_sources)
    return out


def _verify(c: Simulated, n_units: int, n_sources: int) -> None:
    """The counts that a simulated corpus promises."""
    held = np.zeros((n_sources, len(c.groups)), bool)
    held[c.source, c.group] = True
    got = {"units": len(np.unique(c.unit)), "sources": int(held.any(1).sum()), "crossing": int((held.sum(1) > 1).sum())}
    want = {"units": n_units, "sources": n_sources, "crossing": c.n_crossing}
    if got != want:
        raise RuntimeError(f"the simulated corpus has {got}, not {want}")


def simulated_frame(spark: SparkSession, n_units: int, n_sources: int, crossing: float, **options) -> DataFrame:
    """A simulated corpus as an analytical frame."""
    import pandas as pd

    c = simulate(n_units, n_sources, crossing, **options)
    named = pd.DataFrame({"source": [f"S{i:04d}" for i in c.source], "unit": [f"U{i:04d}" for i in c.unit], "group": [c.groups[g] for g in c.group], "weight": c.mass})
    return spark.createDataFrame(named)


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) if len(p) > 1 else 0.0


def score(c: Simulated) -> dict[str, float]:
    """Ratio, ceiling (two groups only), entropies, rows and crossing sources of a simulated corpus."""
    w = np.zeros((int(c.source.max()) + 1, len(c.groups)))
    np.add.at(w, (c.source, c.group), c.mass)
    p = w / w.sum()
    n = p.sum(1)
    top = _entropy(p.sum(0))
    inside = sum(n[i] * _entropy(p[i] / n[i]) for i in np.flatnonzero(n > 0))
    inside = min(max(inside, 0.0), top)
    ceiling = None
    if len(c.groups) == 2:
        q = p[:, 0] / n
        pi = p[:, 0].sum()
        at = np.unique(np.concatenate([[0.0, 1.0], q]))
        sens = np.minimum(at[:, None], q) @ n / pi
        spec = np.minimum(1 - at[:, None], 1 - q) @ n / (1 - pi)
        ceiling = float(np.clip(((sens + spec) / 2).max(), 0.5, 1.0))
    return {"ratio": inside / top if top > 0 else None, "ceiling": ceiling, "h_group": top, "h_group_given_source": inside, "n_rows": len(c.source), "n_spanning": int(((w > 0).sum(1) > 1).sum())}


def seeds(seed: int | Sequence[int], n: int) -> np.ndarray:
    """n addressed seeds of a run."""
    return np.random.default_rng(seed).integers(0, _MAX_SEED, n, dtype=np.int64)


def scored(spark: SparkSession, draws: list[tuple]) -> DataFrame:
    """Simulates and scores draws (cell, rep, n_units, n_sources, crossing, seed, extra_rows, dispersion, sizes or None) in parallel."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                sizes = None if r.sizes is None else [int(x) for x in r.sizes]
                c = simulate(int(r.n_units), int(r.n_sources), float(r.crossing), sizes=sizes, seed=int(r.seed), extra_rows=float(r.extra_rows), dispersion=float(r.dispersion))
                out.append({"cell": r.cell, "rep": r.rep, **score(c)})
            yield pd.DataFrame(out, columns=["cell", "rep", "ratio", "ceiling", "h_group", "h_group_given_source", "n_rows", "n_spanning"]).astype({"ratio": float, "ceiling": float})

    todo = spark.createDataFrame(draws, _DRAW).repartition(max(1, min(256, len(draws) // 50)), "cell", "rep")
    out = todo.mapInPandas(run, _SCORE)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ratio", "ceiling")})


def statistic(value: str, name: str) -> Column:
    """Aggregate 'mean', 'median' or 'p<q>' of defined values."""
    if name == "mean":
        return F.avg(value)
    if name == "median":
        return F.median(value)
    try:
        q = float(name.removeprefix("p")) if name.startswith("p") else None
    except ValueError:
        q = None
    if q is None or not 0 <= q <= 100:
        raise ValueError(f"a statistic is mean, median or p<q>, not {name!r}")
    return F.percentile(value, F.lit(q / 100))


def _spread(c: str) -> list[Column]:
    return [
        F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.percentile(c, F.lit(0.05)).alias(f"{c}_p05"), F.median(c).alias(f"{c}_median"), F.percentile(c, F.lit(0.95)).alias(f"{c}_p95"),
    ]


def design_curve(spark: SparkSession, n_units: int, n_sources: int, crossing_fractions: Sequence[float], *, replicates: int = 200, seed: int = 0, sizes=None, extra_rows: float = 1.0, dispersion: float = 0.0) -> DataFrame:
    """Spread of ratio and ceiling for each crossing fraction."""
    fractions = [float(f) for f in crossing_fractions]
    if not fractions or replicates < 1:
        raise ValueError("a curve needs a fraction and a replicate at least")
    size = list(group_sizes(n_units, sizes).values())
    s = seeds(seed, len(fractions) * replicates)
    draws = [(i, j, n_units, n_sources, f, int(s[i * replicates + j]), extra_rows, dispersion, size) for i, f in enumerate(fractions) for j in range(replicates)]
    cells = spark.createDataFrame([(i, f, round(f * n_sources)) for i, f in enumerate(fractions)], "cell long, crossing_fraction double, n_crossing_sources long")
    agg = scored(spark, draws).groupBy("cell").agg(F.count(F.lit(1)).alias("n_rep"), *_spread("ratio"), *_spread("ceiling"), F.avg((F.abs("ratio") <= 1e-12).cast("double")).alias("frac_ratio_zero"))
    return cells.join(agg, "cell").drop("cell")


#: Spread of the realized crossing around the aim of a draw.
AIM_SPREAD = 0.15


def random_draws(seed: int, aims: Sequence[float | None], *, units=(12, 120), sources=(6, 60), minority=(0.2, 0.5), extra_rows=(0.0, 3.0), dispersion=(0.0, 1.0)) -> list[tuple]:
    """Random designs, drawn setting by setting on the driver; their simulation runs in parallel. An aim of None is any crossing fraction."""
    n, streams = len(aims), [np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(7)]
    between = lambda k, low, high: streams[k].uniform(low, high, n)
    u, d = (streams[k].integers(low, high, n, endpoint=True) for k, (low, high) in enumerate((units, sources)))
    small = np.clip(np.rint(between(2, *minority) * u), 1, u - 1).astype(int)
    aim = np.array([np.nan if a is None else a for a in aims], float)
    cross = np.where(np.isnan(aim), between(3, 0, 1), np.clip(np.nan_to_num(aim) + streams[3].normal(0, AIM_SPREAD, n), 0, 1))
    cols = [u, d, cross, streams[4].integers(0, _MAX_SEED, n), between(5, *extra_rows), between(6, *dispersion)]
    return [(0, rep, *row, [k, row[0] - k]) for rep, (row, k) in enumerate(zip(zip(*(c.tolist() for c in cols)), small.tolist()))]


def simulated_ceiling_envelope(spark: SparkSession, edges: Sequence[float] | None = None, *, replicates: int = 200, seed: int = 0, min_count: int = 5, **ranges) -> DataFrame:
    """Per bin of the realized ratio (the last one closed): designs, observed ratios, and the range of ceilings, null below min_count."""
    edges = [k / 10 for k in range(11)] if edges is None else [float(e) for e in edges]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])) or edges[0] < 0 or edges[-1] > 1:
        raise ValueError("the edges must ascend within [0, 1]")
    if replicates < 1 or min_count < 1:
        raise ValueError("replicates and min_count must be 1 at least")
    rng = np.random.default_rng([seed, 1])
    aims = [float(rng.uniform(a, b)) for a, b in zip(edges, edges[1:]) for _ in range(replicates)]
    s = scored(spark, random_draws(seed, aims, **ranges)).where(F.col("ratio").between(edges[0], edges[-1]))
    last = len(edges) - 2
    bin_of = F.lit(last)
    for k in range(last - 1, -1, -1):
        bin_of = F.when(F.col("ratio") < edges[k + 1], F.lit(k)).otherwise(bin_of)
    agg = s.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ratio").alias("ratio_observed_min"), F.max("ratio").alias("ratio_observed_max"), F.min("ceiling").alias("lo"), F.median("ceiling").alias("mid"), F.max("ceiling").alias("hi"),
    )
    bins = spark.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(last + 1)], "bin int, ratio_lo double, ratio_hi double")
    out = bins.join(agg, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shown = lambda c: F.when(F.col("n") >= min_count, F.col(c))
    return out.select(
        "ratio_lo", "ratio_hi", "n", "ratio_observed_min", "ratio_observed_max", shown("lo").alias("ceiling_min"), shown("mid").alias("ceiling_median"), shown("hi").alias("ceiling_max"),
        (shown("hi") - shown("lo")).alias("ceiling_spread"),
    )


def minimum_viable_crossing(spark: SparkSession, target: float, units_grid=(20, 40, 80), sources_grid=(10, 20, 40), *, sizes=None, crossing_grid=None, replicates: int = 100, seed: int = 0, summary: str = "mean", extra_rows: float = 1.0, dispersion: float = 0.0) -> DataFrame:
    """Per (units, sources): the first crossing fraction from which on the summarized ceiling never falls below the target.

    The decision uses the least summary of all later fractions (a suffix
    minimum), so a dip after a first hit counts; `nonmonotonic` says whether there is one.
    """
    if not 0.5 < target <= 1:
        raise ValueError(f"the target must lie in (0.5, 1], not {target}")
    grid = [round(0.05 * k, 4) for k in range(21)] if crossing_grid is None else [float(f) for f in crossing_grid]
    if not grid or any(b <= a for a, b in zip(grid, grid[1:])) or grid[0] < 0 or grid[-1] > 1 or not len(units_grid) or not len(sources_grid) or replicates < 1:
        raise ValueError("the grids must not be empty, and crossing fractions must ascend within [0, 1]")
    if sizes is not None and len(set(units_grid)) > 1:
        raise ValueError("fixed group sizes go with one number of units")
    cells = [(u, d, f) for u in units_grid for d in sources_grid for f in grid]
    s = seeds(seed, len(cells) * replicates)
    draws = [(i, j, u, d, f, int(s[i * replicates + j]), extra_rows, dispersion, list(group_sizes(u, sizes).values())) for i, (u, d, f) in enumerate(cells) for j in range(replicates)]
    named = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell long, n_units int, n_sources int, f double")
    curve = scored(spark, draws).groupBy("cell").agg(statistic("ceiling", summary).alias("ceiling"), statistic("ratio", summary).alias("ratio")).join(named, "cell")
    by = Window.partitionBy("n_units", "n_sources").orderBy("f")
    curve = curve.withColumns({"future": F.min("ceiling").over(by.rowsBetween(0, Window.unboundedFollowing)), "falls": F.col("ceiling") < F.lag("ceiling").over(by)})
    hit = F.min(F.when(F.col("future") >= target, F.struct("f", "future", "ceiling", "ratio")))
    out = curve.groupBy("n_units", "n_sources").agg(hit.alias("h"), F.coalesce(F.max("falls"), F.lit(False)).alias("nonmonotonic"), F.max("ceiling").alias("best_ceiling"))
    return out.select(
        "n_units", "n_sources", F.lit(float(target)).alias("target_ceiling"), F.lit(summary).alias("statistic"), F.col("h.f").alias("min_crossing_fraction"),
        F.rint(F.col("h.f") * F.col("n_sources")).alias("min_crossing_sources"), F.col("h.future").alias("achieved_ceiling"), F.col("h.ceiling").alias("raw_ceiling_at_crossing"),
        F.col("h.ratio").alias("achieved_ratio"), "best_ceiling", "nonmonotonic",
    )


def _rising(y: Sequence[float]) -> list[float]:
    """The rising curve nearest to y by squares: neighbours that fall are pooled into their mean."""
    pools: list[tuple[float, int]] = []
    for v in y:
        pools.append((v, 1))
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (b, m), (a, n) = pools.pop(), pools.pop()
            pools.append(((a * n + b * m) / (n + m), n + m))
    return [v for v, n in pools for _ in range(n)]


def estimator_behavior(spark: SparkSession, target_ratio: float, sources_grid=(5, 10, 20, 40, 80), units_grid=(20, 50, 100), *, replicates: int = 200, seed: int = 0, reference: tuple[int, int] = (200, 200), calibration_points: int = 21, calibration_rep: int = 20, reference_rep: int = 50, extra_rows: float = 1.0, dispersion: float = 0.0) -> DataFrame:
    """Bias, spread and RMSE of the ratio at small sizes against a large reference design tuned to the target ratio.

    The crossing fraction comes from a calibration curve, made to rise by averaging; the reference is what the
    large design reaches there with fresh seeds.
    """
    if not 0 <= target_ratio <= 1 or min(replicates, calibration_rep) < 1 or calibration_points < 2 or reference_rep < 2:
        raise ValueError("the target must lie in [0, 1] and the numbers of draws must be positive")
    units, sources = reference
    half = list(group_sizes(units).values())
    tuning, fresh, small = np.random.SeedSequence(seed).generate_state(3).tolist()
    at_reference = lambda f, s, n: [(i, j, units, sources, x, int(k), extra_rows, dispersion, half) for i, x in enumerate(f) for j, k in enumerate(seeds([s, i], n))]
    f = [k / (calibration_points - 1) for k in range(calibration_points)]
    # the curve is made to rise by averaging neighbours that fall: the nearest rising curve by squares
    means = scored(spark, at_reference(f, tuning, calibration_rep)).groupBy("cell").agg(F.avg("ratio").alias("m")).orderBy("cell").collect()
    curve = _rising([r.m for r in means])
    if not curve[0] <= target_ratio <= curve[-1]:
        raise ValueError(f"the reference design reaches ratios from {curve[0]:.4f} to {curve[-1]:.4f}, not {target_ratio}")
    k = max(1, next(k for k, y in enumerate(curve) if y >= target_ratio))
    rise = curve[k] - curve[k - 1]
    f_star = f[k - 1] + (f[k] - f[k - 1]) * (min(max((target_ratio - curve[k - 1]) / rise, 0.0), 1.0) if rise > 0 else 0.0)
    r = scored(spark, at_reference([f_star], fresh, reference_rep)).agg(F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("sd"), F.count("ratio").alias("n")).first()
    cells = [(d, u) for d in sources_grid for u in units_grid]
    s = seeds(small, len(cells) * replicates)
    draws = [(i, j, u, d, f_star, int(s[i * replicates + j]), extra_rows, dispersion, list(group_sizes(u).values())) for i, (d, u) in enumerate(cells) for j in range(replicates)]
    named = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell long, n_sources int, n_units int")
    off = F.col("ratio") - r.m
    agg = scored(spark, draws).groupBy("cell").agg(
        F.avg("ratio").alias("mean_ratio"), F.avg(off).alias("bias"), F.stddev_samp("ratio").alias("sd"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg("n_spanning").alias("mean_spanning_sources"), F.count("ratio").alias("n_finite"),
    )
    ref_cols = {"target_ratio": target_ratio, "crossing_fraction": f_star, "reference_ratio": r.m, "reference_ratio_sd": r.sd, "reference_ratio_sem": r.sd / r.n**0.5, "calibration_error": r.m - target_ratio}
    return named.join(agg, "cell").drop("cell").withColumns({k: F.lit(float(v)) for k, v in ref_cols.items()})


def operating_characteristic(spark: SparkSession, thresholds: Sequence[float] | None = None, *, estimable_ceiling: float = 0.75, n_designs: int = 600, seed: int = 0, **ranges) -> DataFrame:
    """How well 'ratio below a threshold' finds designs whose ceiling is below estimable_ceiling; all thresholds on one sample of designs."""
    thresholds = [round(0.05 * k, 4) for k in range(1, 20)] if thresholds is None else [float(t) for t in thresholds]
    if not thresholds or n_designs < 1 or not 0.5 < estimable_ceiling <= 1:
        raise ValueError("thresholds and designs are needed, and a ceiling in (0.5, 1]")
    s = scored(spark, random_draws(seed, [None] * n_designs, **ranges)).where("ratio is not null and ceiling is not null")
    rows = s.select("ratio", (F.col("ceiling") >= estimable_ceiling).alias("fine"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("ratio") < F.col("threshold")
    agg = rows.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_designs"), F.count_if(hit & ~F.col("fine")).alias("tp"), F.count_if(hit & F.col("fine")).alias("fp"), F.count_if(~hit & ~F.col("fine")).alias("fn"),
        F.count_if(~hit & F.col("fine")).alias("tn"),
    )
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sens, spec = rate(tp, tp + fn), rate(tn, tn + fp)
    return agg.select(
        "threshold", "n_designs", F.lit(float(estimable_ceiling)).alias("estimable_ceiling"), rate(tn + fp, F.col("n_designs")).alias("prevalence_estimable"), (tp + fp).alias("n_flagged"),
        rate(fp, fp + tn).alias("false_alarm_rate"), rate(fn, tp + fn).alias("miss_rate"), sens.alias("sensitivity"), spec.alias("specificity"), (sens + spec - 1).alias("youden_j"),
        rate(tp, tp + fp).alias("ppv"), rate(tn, tn + fn).alias("npv"),
    )
