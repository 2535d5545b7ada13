"""The best balanced accuracy that a predictor of the source's label mix can reach, for two groups.

For a threshold mass q the accuracy is piecewise linear in q and has its
corners at the sources' positive shares, so all candidates are evaluated from
running sums over the shares instead of one pass per candidate.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach, running

CHANCE = 0.5


def binary_table(w: DataFrame, positive: str | None = None) -> tuple[DataFrame, str, str]:
    """source, pos, neg masses; the positive group (the first by default) and the negative one. ValueError unless there are two."""
    groups = [r[0] for r in w.select("group").distinct().orderBy("group").limit(3).collect()]
    if len(groups) != 2:
        raise ValueError(f"a ceiling needs two groups, not {len(groups)} or more: {groups}; regroup or take a subset first")
    if positive is None:
        positive = groups[0]
    if positive not in groups:
        raise ValueError(f"{positive!r} is none of the groups {groups}")
    negative = groups[1 - groups.index(positive)]
    mass = lambda g: F.coalesce(F.sum(F.when(F.col("group") == F.lit(g), F.col("weight"))), F.lit(0.0))
    return w.groupBy("source").agg(mass(positive).alias("pos"), mass(negative).alias("neg")), positive, negative


def frontier(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every candidate q with its sensitivity, specificity and balanced accuracy: by, q, sensitivity, specificity, accuracy, prior_positive."""
    live = table.where("pos + neg > 0").withColumn("n", F.col("pos") + F.col("neg"))
    totals = live.groupBy(*by).agg(F.sum("n").alias("all_mass"), F.sum("pos").alias("all_pos"))
    live = live.join(F.broadcast(totals), list(by)) if by else attach(live, totals)
    live = live.withColumns({"q": F.col("pos") / F.col("n"), "c": F.col("n") / F.col("all_mass"), "prior_positive": F.col("all_pos") / F.col("all_mass")})
    at = live.groupBy(*by, "prior_positive", "q").agg(F.sum("c").alias("c")).withColumn("cp", F.col("c") * F.col("q"))
    sums = running(at, "q", {"below": "c", "below_pos": "cp"}, by=by)
    q, pi = F.col("q"), F.col("prior_positive")
    sens = (F.col("below_pos") + q * (1 - F.col("below"))) / pi
    spec = ((1 - q) * F.col("below") + (1 - pi) - (F.col("below") - F.col("below_pos"))) / (1 - pi)
    inner = sums.where((pi > 0) & (pi < 1)).select(*by, "q", sens.alias("sensitivity"), spec.alias("specificity"), "prior_positive")
    # q = 0 and q = 1 call every source one way
    ends = at.select(*by, "prior_positive").distinct().where((pi > 0) & (pi < 1)).withColumn("q", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    ends = ends.select(*by, "q", F.col("q").alias("sensitivity"), (1 - F.col("q")).alias("specificity"), "prior_positive")
    return inner.unionByName(ends).withColumn("accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def _best(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The highest accuracy; of those equal up to 1e-12 the least q."""
    rank = F.struct((-F.round("accuracy", 12)).alias("a"), F.col("q"), "sensitivity", "specificity", "accuracy", "prior_positive")
    out = points.groupBy(*by).agg(F.min(rank).alias("b"))
    return out.select(*by, F.col("b.accuracy").alias("exact"), F.col("b.q").alias("q_star"), "b.sensitivity", "b.specificity")


def kappas(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """kappa_positive, kappa_negative (expected share of the other group where a group's mass lies), prior_positive and numbers of sources."""
    n = F.col("pos") + F.col("neg")
    part = lambda g: F.sum(F.when(n > 0, F.col(g) * (1 - F.col(g) / n)))
    out = table.groupBy(*by).agg(
        part("pos").alias("a"), part("neg").alias("b"), F.sum("pos").alias("P"), F.sum("neg").alias("M"), F.count(F.lit(1)).alias("n_sources"),
        F.count_if(n <= 0).alias("n_zero_weight_sources"),
    )
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    total = F.col("P") + F.col("M")
    return out.select(
        *by, share("a", "P").alias("kappa_positive"), share("b", "M").alias("kappa_negative"), F.when(total > 0, F.col("P") / total).alias("prior_positive"),
        total.alias("total_weight"), "n_sources", "n_zero_weight_sources",
    )


def ceiling_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per by): exact, q_star, sensitivity, specificity, relaxation, prior, kappas, numbers; null where a group has no mass."""
    best, k = _best(frontier(table, by), by), kappas(table, by)
    if by:
        out = k.join(best, list(by), "left")
    else:
        out = k.withColumn("__one", F.lit(1)).join(F.broadcast(best.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")
    out = out.withColumn("relaxation", CHANCE + (F.col("kappa_positive") + F.col("kappa_negative")) / 2)
    excess = F.col("exact") - CHANCE
    out = out.withColumn("excess_over_chance", excess).withColumn("relaxation_slack", F.when(excess > 0, (F.col("relaxation") - CHANCE) / excess - 1))
    return out


def balanced_accuracy_ceiling(w: DataFrame, positive: str | None = None) -> DataFrame:
    """The ceiling of a two-group table W; the positive group is the first one unless named."""
    table, positive, negative = binary_table(w, positive)
    return ceiling_of(table).withColumns({"positive_group": F.lit(positive), "negative_group": F.lit(negative)})


def ceiling_sensitivity(w: DataFrame, source: str, masses: Iterable[float], positive: str | None = None) -> DataFrame:
    """The ceiling with one source rescaled to each of the masses, its mix unchanged: mass, share_of_total_weight and the ceiling's columns.

    KeyError for an unknown source, ValueError for a source without mass or a mass that is negative or not finite.
    """
    masses = [float(m) for m in masses]
    if any(not 0 <= m < float("inf") for m in masses):
        raise ValueError(f"masses must be finite and not negative: {masses}")
    table, _, _ = binary_table(w, positive)
    row = table.where(F.col("source") == F.lit(source)).select((F.col("pos") + F.col("neg")).alias("n")).first()
    if row is None:
        raise KeyError(f"no source {source!r}")
    if not row.n > 0:
        raise ValueError(f"source {source!r} has no mass, so it cannot be rescaled")
    grid = table.withColumn("mass", F.explode(F.array(*[F.lit(m) for m in sorted(set(masses))])))
    factor = F.when(F.col("source") == F.lit(source), F.col("mass") / row.n).otherwise(1.0)
    scaled = grid.withColumns({"pos": F.col("pos") * factor, "neg": F.col("neg") * factor})
    out = ceiling_of(scaled, ("mass",))
    return out.withColumn("share_of_total_weight", F.when(F.col("total_weight") > 0, F.col("mass") / F.col("total_weight")))
