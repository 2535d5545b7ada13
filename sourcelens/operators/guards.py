"""Guards: association of source and group, rank of the design, batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach
from sourcelens.operators import ceiling as ceilings
from sourcelens.operators.entropy import label_entropy
from sourcelens.operators.tables import counts, source_group_weight, units_per_source

TOLERANCE = 1e-12


def cramers_v(w: DataFrame) -> DataFrame:
    """One row: cramers_v and cramers_v_bc (bias-corrected), null where undefined.

    phi^2 = sum of w^2 / (R * C) - 1 over the cells that exist, so empty cells
    of the crosstab are never made.
    """
    total = w.agg(F.sum("weight").alias("n"))
    p = attach(w.where("weight > 0"), total).select("source", "group", "n", (F.col("weight") / F.col("n")).alias("p"))
    rows, cols = p.groupBy("source").agg(F.sum("p").alias("r")), p.groupBy("group").agg(F.sum("p").alias("c"))
    cells = p.join(rows, "source").join(cols, "group")
    phi = cells.agg(F.sum(F.col("p") * F.col("p") / (F.col("r") * F.col("c"))).alias("s"), F.max("n").alias("n"))
    shape = attach(rows.agg(F.count(F.lit(1)).alias("R")), cols.agg(F.count(F.lit(1)).alias("C")))
    x = attach(phi, shape).withColumn("phi2", F.greatest(F.col("s") - 1, F.lit(0.0)))
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    defined = (F.col("R") >= 2) & (F.col("C") >= 2)
    n1 = F.col("n") - 1
    fix = lambda k: F.col(k) - (F.col(k) - 1) * (F.col(k) - 1) / n1
    phi2_t = F.greatest(F.lit(0.0), F.col("phi2") - (F.col("R") - 1) * (F.col("C") - 1) / n1)
    room = F.least(fix("R"), fix("C")) - 1
    v = unit(F.sqrt(F.col("phi2") / (F.least("R", "C") - 1)))
    v_bc = F.when((F.col("n") > 1), F.when(room > 0, unit(F.sqrt(phi2_t / room))))
    return x.select(F.when(defined, v).alias("cramers_v"), F.when(defined, v_bc).alias("cramers_v_bc"))


def theils_u(w: DataFrame) -> DataFrame:
    """One row: theils_u, the share of the label entropy that the source explains."""
    return label_entropy(w).select(F.col("uncertainty_coefficient").alias("theils_u"))


def min_batch_size(frame: DataFrame) -> DataFrame:
    """source, n_units, from the smallest; equal sizes by key."""
    return units_per_source(frame).orderBy("n_units", "source")


def design_rank(frame: DataFrame) -> DataFrame:
    """One row: rank and columns of [source indicators | group indicators less one], rank_deficient, singleton sources.

    The rank is S + G - k, where k counts the connected components of the graph
    of sources and groups; no matrix is made. Every source names the groups it
    links to its least group, so the graph shrinks to edges between groups: at
    most G distinct ones for each group, and the components are found over these
    by relabelling with the least neighbour.
    """
    pairs = frame.select("source", "group").distinct()
    hub = pairs.groupBy("source").agg(F.min("group").alias("hub"))
    links = pairs.join(hub, "source").select("group", "hub").distinct()
    n_components = _components(links)
    sizes = units_per_source(frame).agg(F.min("n_units").alias("min_batch_size"), F.count_if(F.col("n_units") <= 1).alias("n_singleton_sources"))
    out = attach(counts(frame), sizes)
    columns = F.col("n_sources") + F.greatest(F.col("n_groups") - 1, F.lit(0))
    rank = F.col("n_sources") + F.col("n_groups") - n_components
    return out.select(
        rank.cast("long").alias("design_rank"), columns.cast("long").alias("design_columns"), (rank < columns).alias("rank_deficient"), "n_rows", "n_sources", "n_groups",
        "min_batch_size", "n_singleton_sources",
    )


def _components(links: DataFrame) -> int:
    """Connected components of group-to-group links, each group linked to itself at least."""
    from sourcelens.functions.graph import least_labels

    return least_labels(links.select(F.col("group").alias("a"), F.col("hub").alias("b"))).select("label").distinct().count()


def guard_report(frame: DataFrame, ceiling: float | None = None) -> DataFrame:
    """name, value, threshold, fires (null if the value is undefined), seven rows."""
    w = source_group_weight(frame).persist()
    e = label_entropy(w).select("ratio", "uncertainty_coefficient")
    x = attach(attach(cramers_v(w), e), design_rank(frame))
    n_groups = w.select("group").distinct().limit(3).count()
    if ceiling is not None or n_groups != 2:
        x = x.withColumn("exact", F.lit(ceiling).cast("double"))
    else:
        x = attach(x, ceilings.balanced_accuracy_ceiling(w).select("exact"))
    d = lambda c: F.col(c).cast("double")
    at = lambda c, t: F.abs(d(c) - t) <= TOLERANCE
    rows = [
        ("cramers_v", d("cramers_v"), F.lit(1.0), at("cramers_v", 1)), ("cramers_v_bias_corrected", d("cramers_v_bc"), F.lit(1.0), at("cramers_v_bc", 1)),
        ("theils_u", d("uncertainty_coefficient"), F.lit(1.0), at("uncertainty_coefficient", 1)),
        ("design_rank", d("design_rank"), d("design_columns"), F.col("rank_deficient")), ("min_batch_size", d("min_batch_size"), F.lit(1.0), F.col("min_batch_size") <= 1),
        ("residual_entropy_ratio", d("ratio"), F.lit(0.0), at("ratio", 0)), ("balanced_accuracy_ceiling", d("exact"), F.lit(0.5), d("exact") <= 0.5 + TOLERANCE),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), t.alias("threshold"), F.when(v.isNotNull(), f).alias("fires")) for n, v, t, f in rows])
    return x.select(F.inline(cells))
