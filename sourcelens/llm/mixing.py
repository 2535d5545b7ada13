"""Mixing sources to target weights.

Documents get hash-random keys, are range-sorted within their source, and the
exact budget of the source is cut off by distributed prefix sums of sizes:
totals per key range first, then running sums inside each range. A source has
as many key ranges as its number of documents asks for, so a hot source is
spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelens.llm import common

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all sizes.
SHARE = 1.5
#: No source is taken more often.
MOST = 2
#: Documents in a key range, about.
RANGE_ROWS = 4096
#: Sources whose targets may be broadcast.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"
#: The order of a source's documents; tie, a hash of the text, only matters where whole texts are taken.
ORDER = ["key", "id", "size", "tie"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs in; weight and target added.

    Sources in code-point order, null last, get the weights in turn. Targets
    share `share` of all sizes by weight and stop at `most` times the source's
    size; the excess goes to the others by weight until none is above. That is
    target = min(cap, level * weight); the level is found over the sources in
    the order in which they fill up. One row per source, so one small sort.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    rows = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int")))
    rows = rows.withColumns({"cap": most * F.col("source_size"), "fills_at": (most * F.col("source_size")).cast("double") / F.col("weight")})
    filling = Window.orderBy("fills_at", "place")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("all", F.sum("source_size").over(everything))
    rows = rows.withColumn("level_here", (share * F.col("all") - before) / rest)
    rows = rows.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("fills_at"), F.col("level_here"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def key(id_col: Column, seed: str) -> Column:
    """Hash-random key of a document: hex text, the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def with_taken(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """sized (source, size, key, id) with source_size, target, epochs (whole repeats) and left (words of the partial epoch that begin at the document).

    left is the budget of the partial epoch less all sizes that stand before the
    document: the words taken in it are min(size, left) if left is positive.
    """
    # plain equality on (k, z) lets windows and joins share one shuffle, which null-safe equality would not
    keyed = lambda df: df.withColumns({"k": F.coalesce("source", F.lit("")), "z": F.col("source").isNull()})
    t = keyed(per_source).select("k", "z", "source_size", "n_docs", "target")
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)  # some fifty bytes a source
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long")
    dealt = lambda df: keyed(df).join(t, ["k", "z"]).withColumn("range", F.call_function("shiftright", place, F.lit(32)))
    order = [c for c in ORDER if c in sized.columns]
    inside = Window.partitionBy("k", "z", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(sized).withColumns({"epochs": epochs, "before": F.coalesce(F.sum("size").over(inside), F.lit(0))})
    sums = dealt(sized.select("source", "size", "key")).groupBy("k", "z", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("k", "z").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("k", "z", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("start"))
    out = rows.join(starts, ["k", "z", "range"])
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return out.withColumn("left", budget - F.col("start") - F.col("before")).drop("k", "z", "start", "before", "range", "n_docs")


def _totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))


@common.tracked
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns id_col, size, source_size, target, taken, one row per row of docs.
    Every source's taken words sum to its target, rounded down: the document at
    the cut counts with the words up to the cut. Null texts have size 0; null
    sources are one source, the last; rows that tie in id and size are alike.
    An empty table gives an empty result. Reruns agree, as keys depend on the
    id and the seed only.
    """
    sized = common.written(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), common.word_count(F.col(text_col)).alias("size"), key(F.col(id_col), seed).alias("key"),
    ), "mix")
    out = with_taken(sized, common.written(targets(_totals(sized)), "targets"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


@common.tracked
def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: docs with rows repeated or left out, whole texts, the columns of docs.

    As texts stay whole, the document at a source's cut goes in if at least half
    of it lies before the cut. Documents without a word are in no mix. Rows that
    tie in id and number of words are in the order of a hash of their text; equal
    rows go in together or stay out together. Null
    sources are one source, the last. An empty table gives an empty result.

    A source's documents go in up to a place in its order, so only ids, sizes and
    hashes are shuffled to find that place; texts meet one row per source.
    """
    c = lambda name: F.col(f"`{name}`")
    row = F.struct(*[c(x) for x in docs.columns])
    size = common.word_count(c(text_col))
    named = {"id": c(id_col), "source": c(source_col).cast("string"), "key": key(c(id_col), seed), "tie": F.xxhash64(c(text_col))}
    sized = common.written(docs.select(*[x.alias(n) for n, x in named.items()], size.alias("size")), "mix")
    out = with_taken(sized, common.written(targets(_totals(sized)), "targets"))
    last = F.max(F.when((F.col("size") > 0) & (2 * F.col("left") >= F.col("size")), F.struct(*ORDER)))
    cuts = common.written(out.groupBy("source").agg(F.first("epochs").alias("epochs"), last.alias("last")).withColumnRenamed("source", "of"), "cuts")
    if cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    rows = docs.select(row.alias("row"), *[x.alias(n) for n, x in named.items()], c(text_col).alias("text")).join(cuts, F.col("source").eqNullSafe(F.col("of")))
    own = F.struct("id", common.word_count(F.col("text")).alias("size"), "tie")  # counted again for documents at the cut only
    upto = (F.col("key") < F.col("last.key")) | ((F.col("key") == F.col("last.key")) & (own <= F.struct("last.id", "last.size", "last.tie")))
    worded = F.btrim(common.text_or_empty(F.col("text")), F.lit(common.SPACE)) != ""
    copies = (F.col("epochs") + F.when(upto, 1).otherwise(0)).cast("int")
    kept = rows.where(worded).withColumn("copies", copies).where("copies > 0")
    return kept.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


@common.tracked
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents."""
    return mix(common.table(spark, sf_dir, "documents"))


#: DuckDB SQL up to a relation mixed(columns of mix_in, size, source_size, target, epochs, lft) over the relation `mix_in`.
MIXED_SQL = f"""
m_sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS mkey FROM mix_in),
m_src AS (SELECT source, sum(size)::BIGINT AS source_size FROM m_sized GROUP BY source),
m_w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM m_src),
m_cap AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size AS cap FROM m_w),
m_fill AS (SELECT *, cap::DOUBLE / weight AS fills_at FROM m_cap),
m_level AS (SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY fills_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level_here FROM m_fill),
m_lev AS (SELECT *, max(CASE WHEN level_here <= fills_at THEN level_here END) OVER () AS level FROM m_level),
m_target AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM m_lev),
m_epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM m_target),
mixed AS (SELECT m_sized.*, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT
    - coalesce(sum(size) OVER (PARTITION BY m_sized.source ORDER BY mkey, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft
    FROM m_sized JOIN m_epochs e ON m_sized.source IS NOT DISTINCT FROM e.source)"""

ORACLE = f"""WITH mix_in AS (SELECT * FROM documents), {MIXED_SQL.strip()}
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, lft)))::BIGINT AS taken FROM mixed"""
