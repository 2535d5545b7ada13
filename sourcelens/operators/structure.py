"""How units share sources: sparse counting over the bipartite graph of sources and units.

Numbers of pairs that share a source come without listing the pairs: a source
with k units makes k(k-1)/2 pairs, and a pair that shares c sources is counted
c times. The surplus comes from the pairs of sources that a unit has, which
gives all c >= 2 from a far smaller join. Either join is chosen by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach, n_pairs, ratio
from sourcelens.operators.tables import describe, edges, spanning_sources


#: Units in a block of a source's units, when pairs are listed.
BLOCK_UNITS = 1000


def _met(e: DataFrame, kept: Column) -> DataFrame:
    """unit_a < unit_b for the pairs of e (source, unit, sole) that meet in a source; kept chooses by sole_a and sole_b. A pair comes once per source.

    The units of a source are packed into blocks, and each pair of blocks is one key: a large source goes to many tasks, and no unit is copied per unit.
    """
    sizes = e.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK_UNITS).cast("int").alias("k"))
    dealt = e.join(sizes, "source").withColumn("side", F.pmod(F.xxhash64("unit"), F.col("k")).cast("int"))
    blocks = dealt.groupBy("source", "k", "side").agg(F.collect_list(F.struct("unit", "sole")).alias("u"))
    parts = 2 * int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = blocks.select("source", F.col("side").alias("low"), F.explode(F.sequence(F.col("side"), F.col("k") - 1)).alias("high"), F.col("u").alias("ua")).repartition(parts, "source", "low", "high")
    b = blocks.select("source", F.explode(F.sequence(F.lit(0), F.col("side"))).alias("low"), F.col("side").alias("high"), F.col("u").alias("ub")).repartition(parts, "source", "low", "high")
    cells = a.join(b, ["source", "low", "high"]).select("low", "high", F.explode("ua").alias("a"), "ub")
    pairs = cells.select("low", "high", "a", F.explode("ub").alias("b")).select("low", "high", F.col("a.unit").alias("a"), F.col("a.sole").alias("sole_a"), F.col("b.unit").alias("b"), F.col("b.sole").alias("sole_b"))
    # inside one block both orders of a pair come, across blocks one
    once = pairs.where(kept).where("a < b or (low < high and b < a)")
    return once.select(F.least("a", "b").alias("unit_a"), F.greatest("a", "b").alias("unit_b"))


def shared_source_pairs(frame: DataFrame) -> DataFrame:
    """unit_a < unit_b, n_shared: unit pairs with at least one source in common.

    A pair with a unit of one source shares that one, so only the pairs of units with several sources are shuffled and counted.
    """
    e = edges(frame)
    degree = e.groupBy("unit").agg((F.count(F.lit(1)) == 1).alias("sole"))
    e = e.join(degree, "unit").select("source", "unit", "sole")
    ones = _met(e, F.col("sole_a") | F.col("sole_b")).withColumn("n_shared", F.lit(1).cast("long"))
    rest = e.where("not sole")
    several = _met(rest, F.lit(True)).groupBy("unit_a", "unit_b").agg(F.count(F.lit(1)).alias("n_shared"))
    return ones.unionByName(several)


def _join_sizes(e: DataFrame) -> tuple[int, int]:
    """Rows of the direct join over sources, and of the join over the sources of each unit."""
    by_source = e.groupBy("source").count().agg(F.sum(n_pairs(F.col("count")))).first()[0]
    by_unit = e.groupBy("unit").count().agg(F.sum(n_pairs(F.col("count")))).first()[0]
    return by_source or 0, by_unit or 0


def pairs_sharing(e: DataFrame, keys: list[str], force: str | None = None) -> DataFrame:
    """Number of unit pairs that share a source: keys, n_pairs_sharing; e has source, unit and the keys (constant for a unit).

    Pairs are counted within equal keys. force: 'direct' or 'rewrite'.
    """
    direct, rewritten = _join_sizes(e) if force is None else (0, 0)
    if force == "direct" or force is None and direct <= rewritten:
        a, b = e, e.select("source", *keys, F.col("unit").alias("other"))
        met = a.join(b, ["source", *keys]).where("unit < other").select(*keys, "unit", "other").distinct()
        return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs_sharing"))
    made = e.groupBy("source", *keys).count().select(*keys, n_pairs(F.col("count")).alias("n"))
    # m units have both sources of a pair of sources: each pair of these units shares them
    s, t = e.select("unit", *keys, F.col("source").alias("s")), e.select("unit", F.col("source").alias("t"))
    both = s.join(t, "unit").where("s < t")
    # pairs of units that meet in two sources or more: m(u, v) = c(c-1)/2 pairs of sources
    left = both.select(*keys, "s", "t", F.col("unit").alias("u"))
    right = both.select(*keys, "s", "t", F.col("unit").alias("v"))
    m = left.join(right, [*keys, "s", "t"]).where("u < v").groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("m"))
    c = (1 + F.sqrt(1 + 8 * F.col("m"))) / 2
    surplus = m.select(*keys, (-(F.round(c) - 1)).cast("long").alias("n"))
    return made.unionByName(surplus).groupBy(*keys).agg(F.sum("n").alias("n_pairs_sharing"))


def _with_group(frame: DataFrame) -> DataFrame:
    return frame.select("source", "unit", "group").distinct()


def pair_sharing_by_group(frame: DataFrame, force: str | None = None) -> DataFrame:
    """Per group: units, pairs, pairs sharing a source, their rate, sources, sources per unit (mean, max), units with one source."""
    e = _with_group(frame)
    units = e.groupBy("group", "unit").agg(F.count(F.lit(1)).alias("k"))
    per_unit = units.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("k").alias("sources_per_unit_mean"), F.max("k").alias("sources_per_unit_max"), F.count_if(F.col("k") == 1).alias("units_with_one_source"),
    )
    sources = e.groupBy("group").agg(F.count_distinct("source").alias("n_sources"))
    sharing = pairs_sharing(e, ["group"], force)
    out = per_unit.join(sources, "group").join(sharing, "group", "left").withColumn("n_pairs", n_pairs(F.col("n_units")))
    out = out.withColumn("n_pairs_sharing", F.coalesce("n_pairs_sharing", F.lit(0)).cast("long"))
    return out.withColumn("pair_sharing_rate", ratio(F.col("n_pairs_sharing"), F.col("n_pairs")))


def _emptied(frame: DataFrame) -> DataFrame:
    """source, unit, group, sole: whether the unit has no other source."""
    e = _with_group(frame)
    degree = e.groupBy("unit").agg(F.count_distinct("source").alias("k"))
    return e.join(degree, "unit").withColumn("sole", F.col("k") == 1)


def source_removal(frame: DataFrame) -> DataFrame:
    """What the removal of a source would do: source, units_covered, emptied_total, emptied_unit_keys (sorted)."""
    e = _emptied(frame)
    keys = F.array_sort(F.collect_list(F.when(F.col("sole"), F.col("unit"))))
    return e.groupBy("source").agg(F.count_distinct("unit").alias("units_covered"), F.count_if("sole").alias("emptied_total"), keys.alias("emptied_unit_keys"))


def source_removal_by_group(frame: DataFrame) -> DataFrame:
    """The same per source and group: source, group, covers, emptied, frac_emptied (of the group's units); every source with every group it covers."""
    e = _emptied(frame)
    size = e.groupBy("group").agg(F.count_distinct("unit").alias("size"))
    out = e.groupBy("source", "group").agg(F.count_distinct("unit").alias("covers"), F.count_if("sole").alias("emptied")).join(size, "group")
    return out.select("source", "group", "covers", "emptied", ratio(F.col("emptied"), F.col("size")).alias("frac_emptied"))


def spanning_source_table(frame: DataFrame, separator: str = ", ") -> DataFrame:
    """Sources in more than one group: source, n_rows, n_groups, groups, n_units, units (sorted lists as text)."""
    text = lambda c: F.concat_ws(separator, F.array_sort(F.collect_set(F.col(c).cast("string"))))
    out = frame.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group").alias("n_groups"), text("group").alias("groups"), F.count_distinct("unit").alias("n_units"), text("unit").alias("units"))
    return out.where("n_groups > 1")


def concentration(frame: DataFrame, force: str | None = None) -> DataFrame:
    """One row: how much of the pair sharing comes from the source with the most units (the first by key of equal ones)."""
    e = edges(frame).persist()
    one = F.lit(0).alias("k")
    sizes = e.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("source"))).alias("t"), F.count_if(F.col("n") > 1).alias("n_sources_feeding_multiple_units"))
    top = top.select(F.col("t.source").alias("top_source"), (-F.col("t.m")).alias("top_source_units"), "n_sources_feeding_multiple_units")
    key = top.first().top_source
    rest = e.where(F.col("source") != F.lit(key)) if not hasattr(key, "asDict") else e.join(F.broadcast(top.select(F.col("top_source").alias("source"))), "source", "left_anti")
    total = pairs_sharing(e.select("*", one), ["k"], force).agg(F.coalesce(F.max("n_pairs_sharing"), F.lit(0)).alias("n_pairs_sharing"))
    without = pairs_sharing(rest.select("*", one), ["k"], force).agg(F.coalesce(F.max("n_pairs_sharing"), F.lit(0)).alias("without"))
    units = e.agg(F.count_distinct("unit").alias("n_units"))
    out = attach(attach(attach(units, top), total), without).withColumns({"n_pairs": n_pairs(F.col("n_units")), "top_source_pairs": n_pairs(F.col("top_source_units"))})
    lost = F.col("n_pairs_sharing") - F.col("without")
    return out.select(
        "n_units", "n_pairs", "n_pairs_sharing", ratio(F.col("n_pairs_sharing"), F.col("n_pairs")).alias("pair_sharing_rate"), "top_source", "top_source_units", "top_source_pairs",
        ratio(F.col("top_source_pairs"), F.col("n_pairs_sharing")).alias("top_source_share_of_sharing"), F.col("without").alias("n_pairs_sharing_without_top"),
        ratio(lost, F.col("n_pairs_sharing")).alias("share_of_sharing_lost_without_top"), "n_sources_feeding_multiple_units",
    )


def _mass_in_spanning(frame: DataFrame) -> DataFrame:
    span = spanning_sources(frame).select("source")
    return frame.join(span, "source", "left_semi").agg(F.count(F.lit(1)).alias("rows_in_spanning_sources"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_in_spanning_sources"))


def design_summary(frame: DataFrame, force: str | None = None) -> DataFrame:
    """One row: describe(), concentration(), rates over groups and pairs across groups. Mass enters weight_in_spanning_sources and total_weight only."""
    con = concentration(frame, force).drop("n_units")
    by_group = pair_sharing_by_group(frame, force)
    rates = by_group.agg(
        F.min("pair_sharing_rate").alias("pair_sharing_rate_min"), F.max("pair_sharing_rate").alias("pair_sharing_rate_max"), F.count("pair_sharing_rate").alias("k"),
        F.sum("n_pairs").alias("within_pairs"), F.sum("n_pairs_sharing").alias("within_sharing"),
    )
    out = attach(attach(attach(describe(frame), con), rates), _mass_in_spanning(frame))
    out = out.withColumn("pair_sharing_rate_gap", F.when(F.col("k") > 1, F.col("pair_sharing_rate_max") - F.col("pair_sharing_rate_min")))
    out = out.withColumns({"n_cross_group_pairs": F.col("n_pairs") - F.col("within_pairs"), "n_cross_group_pairs_sharing": F.col("n_pairs_sharing") - F.col("within_sharing")})
    return out.withColumn("cross_group_pair_sharing_rate", ratio(F.col("n_cross_group_pairs_sharing"), F.col("n_cross_group_pairs"))).drop("k", "within_pairs", "within_sharing")


def worst_removals(frame: DataFrame) -> DataFrame:
    """Per group the source whose removal empties the largest share of its units (the first by key of equal ones)."""
    best = F.min(F.struct((-F.col("frac_emptied")).alias("f"), F.col("source"))).alias("b")
    out = source_removal_by_group(frame).groupBy("group").agg(best)
    return out.select("group", (-F.col("b.f")).alias("worst_removal_fraction"), F.col("b.source").alias("worst_removal_source"))


