"""Residual label entropy given the source, from the sparse table W(source, group, weight)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach, ratio, xlog2x
from sourcelens.operators.tables import source_group_weight

TOLERANCE = 1e-12
#: Cells (sources times groups) of the table that a bootstrap may send to every executor.
MAX_CELLS = 20_000_000


def shannon(masses: Column) -> Column:
    """Aggregate: entropy in bits of non-negative masses; null if they sum to 0."""
    n = F.sum(masses)
    return F.when(n > 0, F.log2(n) - F.sum(xlog2x(masses)) / n)


def shannon_of(values) -> float:
    """Entropy in bits of a sequence; nan without mass, ValueError on negative or non-finite values."""
    p = np.asarray(list(values), float)
    if not np.isfinite(p).all() or (p < 0).any():
        raise ValueError("masses must be finite and not negative")
    if p.sum() <= 0:
        return float("nan")
    p = p[p > 0] / p.sum()
    return float(np.log2(1 / p) @ p)


def _shares(w: DataFrame) -> DataFrame:
    """W with weights divided by their total, so that any scale of weights is safe."""
    total = w.agg(F.sum("weight").alias("total_weight"))
    return attach(w, total).withColumn("p", ratio(F.col("weight"), F.col("total_weight")))


def per_source(w: DataFrame) -> DataFrame:
    """weight, source_probability, n_groups_present (with mass), spanning, h_given_source, contribution of every source.

    The entropy of a source without mass is null and its contribution 0.
    """
    rows = _shares(w).groupBy("source").agg(
        F.sum("weight").alias("weight"), F.sum("p").alias("source_probability"), F.count_if(F.col("p") > 0).alias("n_groups_present"), shannon(F.col("p")).alias("h"),
    )
    h = F.when(F.col("n_groups_present") == 1, F.lit(0.0)).otherwise(F.greatest(F.col("h"), F.lit(0.0)))
    out = rows.withColumn("h_given_source", h).withColumn("spanning", F.col("n_groups_present") > 1)
    return out.withColumn("contribution", F.coalesce(F.col("source_probability") * F.col("h_given_source"), F.lit(0.0))).drop("h")


def label_entropy(w: DataFrame) -> DataFrame:
    """One row: h_group, h_group_given_source, mutual_information, ratio, uncertainty_coefficient and numbers of sources.

    ratio and uncertainty are null if all mass is in one group. Both entropies
    come from one scan of W: sums per source and sums per group meet in one
    union, so no table is joined.
    """
    p = _shares(w)
    by_source = p.groupBy("source").agg(F.sum("p").alias("n"), F.sum(xlog2x(F.col("p"))).alias("s"), F.count_if(F.col("p") > 0).alias("present"))
    by_group = p.groupBy("group").agg(F.sum("p").alias("n"))
    within = F.when(F.col("present") > 1, F.greatest(xlog2x(F.col("n")) - F.col("s"), F.lit(0.0))).otherwise(0.0)
    parts = by_source.select(F.lit(True).alias("is_source"), "n", "present", within.alias("v")).unionByName(
        by_group.select(F.lit(False).alias("is_source"), "n", F.lit(0).cast("long").alias("present"), (-xlog2x(F.col("n"))).alias("v"))
    )
    own, live = F.col("is_source"), F.col("n") > 0
    out = parts.agg(
        F.sum(F.when(~own, F.col("v"))).alias("h_group"), F.sum(F.when(own, F.col("v"))).alias("h_within"), F.count_if(own).alias("n_sources"),
        F.count_if(own & live & (F.col("present") > 1)).alias("n_spanning_sources"), F.count_if(own & live & (F.col("present") <= 1)).alias("n_nested_sources"),
        F.count_if(own & ~live).alias("n_zero_weight_sources"), F.count_if(~own & live).alias("n_live_groups"),
    )
    hg = F.when(F.col("n_live_groups") <= 1, F.lit(0.0)).otherwise(F.greatest(F.col("h_group"), F.lit(0.0)))
    out = out.withColumn("h_group", hg).withColumn("h_group_given_source", F.least(F.col("h_within"), F.col("h_group")))
    r = ratio(F.col("h_group_given_source"), F.col("h_group"))
    return out.select(
        "h_group", "h_group_given_source", (F.col("h_group") - F.col("h_group_given_source")).alias("mutual_information"), r.alias("ratio"), (1 - r).alias("uncertainty_coefficient"),
        "n_sources", "n_spanning_sources", "n_nested_sources", "n_zero_weight_sources",
    )


def leave_one_source_out(w: DataFrame) -> DataFrame:
    """Ratio without each source, in closed form from one pass instead of one run per source.

    Without source d, N' = N - n_d, group masses are T_g - w_dg, and the within
    part loses d's own. Only groups that d has change, so the work is that of W.
    Columns: source, ratio_without, delta_ratio, abs_delta_ratio, pct_change,
    h_group_without, h_group_given_source_without, original_contribution.
    """
    p = _shares(w).select("source", "group", "p")
    groups = p.groupBy("group").agg(F.sum("p").alias("t"))
    sources = per_source(w).select("source", "source_probability", "contribution")
    # what d alone does to sum_g f(T_g); differences that are rounding only count as 0
    rest = F.col("t") - F.col("p")
    rest = F.when(rest <= F.col("t") * 1e-15, F.lit(0.0)).otherwise(rest)
    change = p.join(groups, "group").groupBy("source").agg(F.sum(xlog2x(F.col("t")) - xlog2x(rest)).alias("change"), F.count_if((F.col("t") > 0) & (rest <= 0)).alias("groups_gone"))
    whole = groups.agg(F.sum(xlog2x(F.col("t"))).alias("f_all"), F.count_if(F.col("t") > 0).alias("n_live"))
    base = label_entropy(w).select(F.col("ratio").alias("base"), F.col("h_group_given_source").alias("h_within"))
    x = attach(attach(sources.join(change, "source"), whole), base)
    n = F.lit(1.0) - F.col("source_probability")
    n = F.when(n > 1e-15, n)
    hg = F.when(F.col("n_live") - F.col("groups_gone") <= 1, F.lit(0.0)).otherwise(F.greatest(F.log2(n) - (F.col("f_all") - F.col("change")) / n, F.lit(0.0)))
    x = x.withColumn("h_group_without", F.when(n.isNotNull(), hg))
    left = F.col("h_within") - F.col("contribution")
    left = F.when(left < 1e-15, F.lit(0.0)).otherwise(left)
    x = x.withColumn("h_group_given_source_without", F.least(left / n, F.col("h_group_without")))
    x = x.withColumn("ratio_without", ratio(F.col("h_group_given_source_without"), F.col("h_group_without")))
    x = x.withColumn("delta_ratio", F.col("ratio_without") - F.col("base"))
    pct = F.when(F.abs("base") > TOLERANCE, 100 * F.col("delta_ratio") / F.col("base"))
    return x.select(
        "source", "ratio_without", "delta_ratio", F.abs("delta_ratio").alias("abs_delta_ratio"), pct.alias("pct_change"), "h_group_without", "h_group_given_source_without",
        F.col("contribution").alias("original_contribution"),
    )


@dataclass(frozen=True)
class BootstrapResult:
    """Percentile interval of the ratio over resampled sources."""

    observed: float
    lower: float
    upper: float
    n_effective: int
    n_degenerate: int
    frac_exactly_zero: float
    draws: DataFrame


def bootstrap_draws(w: DataFrame, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """replicate, ratio (null if degenerate): sources resampled with replacement, as many as there are.

    A draw needs all of W, so W goes to the executors in one broadcast of at
    most MAX_CELLS cells (ValueError beyond it); replicates are spread over tasks. The
    indices are those of one sequential generator; a task makes the earlier
    ones too and drops them, so results do not depend on the number of tasks.
    """
    spark = w.sparkSession
    size = w.agg(F.count_distinct("source") * F.count_distinct("group")).first()[0]
    if size > MAX_CELLS:
        raise ValueError(f"a bootstrap over {size} cells is not supported; the bound is {MAX_CELLS}")
    table = w.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("group", "weight"))).alias("m")).orderBy("source").collect()
    names = sorted({g for r in table for g in r.m}, key=str)
    x = np.array([[r.m.get(g, 0.0) for g in names] for r in table], float).reshape(len(table), len(names))
    shared = spark.sparkContext.broadcast(x)

    def run(batches):
        import pandas as pd

        x = shared.value
        k = len(x)
        n = x.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = x / n[:, None]
            h = -np.nansum(np.where(q > 0, q * np.log2(np.where(q > 0, q, 1)), 0), axis=1)
        for batch in batches:
            lo, hi = int(batch.id.min()), int(batch.id.max()) + 1
            draws = np.random.default_rng(seed).integers(0, k, (hi, k))[lo:]
            out = []
            for idx in draws:
                total, groups = n[idx].sum(), x[idx].sum(0)
                p = groups[groups > 0] / total if total > 0 else np.zeros(0)
                top = float(np.log2(1 / p) @ p) if len(p) > 1 else 0.0
                out.append(float(n[idx] @ np.nan_to_num(h[idx])) / total / top if top > 0 else None)
            yield pd.DataFrame({"replicate": range(lo, hi), "ratio": pd.Series(out, dtype="float64")})

    tasks = max(1, min(64, replicates // 200))
    out = spark.range(0, replicates, 1, tasks).mapInPandas(run, "replicate long, ratio double")
    return out.withColumn("ratio", F.when(~F.isnan("ratio"), F.col("ratio")))


def bootstrap_ratio(w: DataFrame, replicates: int = 10_000, seed: int = 0) -> BootstrapResult:
    """Observed ratio and the 2.5 and 97.5 percentiles over replicates whose ratio is defined."""
    draws = bootstrap_draws(w, replicates, seed).persist()
    row = draws.agg(
        F.count("ratio").alias("n"), F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"),
        F.avg((F.abs("ratio") <= 1e-8).cast("double")).alias("zero"),
    ).first()
    nan = lambda v: float("nan") if v is None else v
    observed = label_entropy(w).first().ratio
    return BootstrapResult(nan(observed), nan(row.lo), nan(row.hi), row.n, replicates - row.n, nan(row.zero), draws)


def frame_entropy(frame: DataFrame) -> DataFrame:
    """label_entropy of a frame."""
    return label_entropy(source_group_weight(frame))
