"""Queries over the designs: corpus, entropy, ceiling, structure, guards and grains, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions.keys import with_row_position
from sourcelens.operators import ceiling, entropy, grain, guards, structure, tables
from sourcelens.operators import corpus as corpora
from sourcelens.plans import designs as D

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 9

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum do not count; -0 becomes 0."""
    cols = [(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols)


def sql_rounded(body: str, columns: dict[str, str]) -> str:
    """SELECT of named expressions over body; those marked r are rounded, b are counts."""
    cells = {"r": "round(({x})::DOUBLE, 9) + 0.0", "b": "({x})::BIGINT", "": "{x}"}
    out = []
    for name, spec in columns.items():
        kind, _, x = spec.partition(":")
        out.append(f'{cells[kind].format(x=x or name)} AS "{name}"')
    return f"{body} SELECT {', '.join(out)}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


A = f"WITH f AS ({D.ORDERS_SQL})"
B2 = f"WITH f AS ({D.BINARY_SQL})"
LB = f"WITH f AS ({D.LABELS_SQL})"
LC = f"WITH f AS ({D.LANGUAGES_SQL})"
SG = f"WITH f AS ({D.SEGMENTS_SQL})"
W = ', w AS (SELECT source, "group", sum(weight) AS weight FROM f GROUP BY ALL), p AS (SELECT *, weight / sum(weight) OVER () AS p FROM w)'
EDGES = ", e AS (SELECT DISTINCT source, unit FROM f)"

# corpus ------------------------------------------------------------------

_COUNTS = {"n_rows": "b:count(*)", "n_sources": "b:count(DISTINCT source)", "n_units": "b:count(DISTINCT unit)", "n_groups": 'b:count(DISTINCT "group")', "total_weight": "r:sum(weight)"}


@query("corpus_counts", sql_rounded(A, _COUNTS) + " FROM f")
def corpus_counts(spark, sf_dir):
    return tables.counts(D.orders_design(spark, sf_dir))


_DUPS = ', k AS (SELECT source, unit, "group", count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1)'
_DESCRIBE = f"""{A}{EDGES}{_DUPS}, s AS (SELECT source, count(*) AS n FROM e GROUP BY 1), u AS (SELECT unit, count(*) AS n FROM e GROUP BY 1),
    sp AS (SELECT source FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1)"""


@query("describe", sql_rounded(_DESCRIBE, _COUNTS | {
    "n_duplicate_keys": "b:(SELECT count(*) FROM k)", "n_duplicate_rows": "b:(SELECT coalesce(sum(n - 1), 0) FROM k)",
    "units_per_source_median": "r:(SELECT median(n) FROM s)", "units_per_source_max": "b:(SELECT max(n) FROM s)",
    "sources_per_unit_median": "r:(SELECT median(n) FROM u)", "sources_per_unit_max": "b:(SELECT max(n) FROM u)",
    "units_with_one_source": "b:(SELECT count(*) FROM u WHERE n = 1)", "n_spanning_sources": "b:(SELECT count(*) FROM sp)",
}) + " FROM f")
def describe(spark, sf_dir):
    return tables.describe(D.orders_design(spark, sf_dir))


@query("source_group_weight", sql_rounded(A + W, {"source": "", "group": ':"group"', "weight": "r:weight"}) + " FROM w")
def source_group_weight(spark, sf_dir):
    return tables.source_group_weight(D.orders_design(spark, sf_dir))


@query("weight_crosstab", f"""{A} SELECT source, {", ".join(f"round(coalesce(sum(weight) FILTER ({chr(34)}group{chr(34)} = '{g}'), 0), 9) AS {chr(34)}{g}{chr(34)}" for g in "FOP")} FROM f GROUP BY source""")
def weight_crosstab(spark, sf_dir):
    return tables.pivoted(D.orders_design(spark, sf_dir), list("FOP"))


@query("incidence_edges", f"{A} SELECT DISTINCT source, unit FROM f")
def incidence_edges(spark, sf_dir):
    return tables.edges(D.orders_design(spark, sf_dir))


@query("unit_group", f'{A} SELECT DISTINCT unit, "group" FROM f')
def unit_group(spark, sf_dir):
    return tables.unit_group(D.orders_design(spark, sf_dir))


@query("units_per_source", f"{A} SELECT source, count(DISTINCT unit) AS n_units FROM f GROUP BY 1")
def units_per_source(spark, sf_dir):
    return tables.units_per_source(D.orders_design(spark, sf_dir))


@query("sources_per_unit", f"{A} SELECT unit, count(DISTINCT source) AS n_sources FROM f GROUP BY 1")
def sources_per_unit(spark, sf_dir):
    return tables.sources_per_unit(D.orders_design(spark, sf_dir))


@query("spanning_sources", f'{LB} SELECT source, count(DISTINCT "group") AS n_groups FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1')
def spanning_sources(spark, sf_dir):
    return tables.spanning_sources(D.labels_design(spark, sf_dir))


_SOURCE_AS_UNIT = A.replace("l_orderkey::VARCHAR AS unit", "l_suppkey::VARCHAR AS unit")


@query("unit_group_violations", f'{_SOURCE_AS_UNIT} SELECT unit, count(DISTINCT "group") AS n_groups FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1')
def unit_group_violations(spark, sf_dir):
    return tables.impure_units(D.orders_design(spark, sf_dir).withColumn("unit", F.col("source")))


def _orders_records(spark, sf_dir):
    o = D.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = D.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return with_row_position(rows.orderBy(*rows.columns))


_ROLES = {"source": "l_suppkey", "unit": "l_orderkey", "group": "o_orderstatus"}
_POSITIONED = """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, o_orderstatus, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_quantity) - 1 AS pos
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("duplicate_report", f"""{_POSITIONED} SELECT l_suppkey::VARCHAR AS source, l_orderkey::VARCHAR AS unit, o_orderstatus AS "group", count(*) AS n_records, count(*) - 1 AS excess_rows,
    CASE WHEN count(DISTINCT l_linenumber) = 1 AND count(DISTINCT l_quantity) = 1 THEN 'exact_record' ELSE 'projected_key_collision' END AS kind, array_to_string(list_filter([CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 'l_linenumber' END, CASE WHEN count(DISTINCT l_quantity) > 1 THEN 'l_quantity' END],
    lambda x: x IS NOT NULL), ',') AS varying_columns, array_to_string(list_sort(list(pos)), ',') AS record_positions FROM r GROUP BY l_suppkey, l_orderkey, o_orderstatus HAVING count(*) > 1""")
def duplicate_report(spark, sf_dir):
    c = corpora.Corpus.from_frame(_orders_records(spark, sf_dir), **_ROLES, duplicates="keep")
    out = c.duplicate_report()
    return out.withColumns({"varying_columns": F.array_join("varying_columns", ","), "record_positions": F.array_join(F.col("record_positions").cast("array<string>"), ",")})


@query("duplicate_drop", f"""{_POSITIONED}, k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY pos) AS nth FROM r)
    SELECT pos AS row_position, nth = 1 AS analysis_included, CASE WHEN nth > 1 THEN 'duplicate_key' END AS exclusion_reason FROM k""")
def duplicate_drop(spark, sf_dir):
    return corpora.Corpus.from_frame(_orders_records(spark, sf_dir), **_ROLES, duplicates="drop").lineage()


def _segments(spark, sf_dir, weight="l_quantity", duplicates="keep"):
    return corpora.Corpus.from_frame(
        D.segments_records(spark, sf_dir), source="l_suppkey", unit="o_orderkey", group="c_mktsegment", weight=weight, duplicates=duplicates, hierarchy={"customer": "c_custkey", "nation": "c_nationkey"}
    )


def _level_sql(level):
    return f"""SELECT '{level}' AS level, count(*) AS n_units, max(np) AS n_parents, count(*) AS n_units_with_parent, 0::BIGINT AS n_units_missing_parent, 0::BIGINT AS n_records_missing_parent,
        0::BIGINT AS n_partially_mapped_units, max(multi) AS n_multi_unit_parents, max(most) AS max_units_per_parent
        FROM (SELECT DISTINCT unit FROM f), (SELECT count(*) AS np, count(*) FILTER (n > 1) AS multi, max(n) AS most FROM (SELECT {level}, count(DISTINCT unit) AS n FROM f GROUP BY 1))"""


@query("hierarchy_report", f"{SG} {_level_sql('customer')} UNION ALL {_level_sql('nation')}")
def hierarchy_report(spark, sf_dir):
    return _segments(spark, sf_dir).hierarchy_report()


@query("at_unit", sql_rounded(f'{SG}, g AS (SELECT DISTINCT source, customer AS unit, "group", 1.0::DOUBLE AS weight FROM f)', _COUNTS).replace("FROM f)", "FROM f)", 1) + " FROM g")
def at_unit(spark, sf_dir):
    return tables.counts(_segments(spark, sf_dir, weight=None).at_unit("customer").frame)


_TEN = ", ".join(f"'{i}'" for i in range(1, 11))


@query("subset", f"""{A} SELECT source, "group", count(*) AS n_rows, round(sum(weight), 9) AS weight FROM f WHERE source IN ({_TEN}) AND "group" IN ('F', 'O') GROUP BY 1, 2""")
def subset(spark, sf_dir):
    frame = D.orders_design(spark, sf_dir)
    c = corpora.Corpus.from_frame(frame, weight="weight", duplicates="keep").subset(sources=[str(i) for i in range(1, 11)], groups=["F", "O"])
    return c.frame.groupBy("source", "group").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"))


@query("crossed_subcorpus", sql_rounded(f'{LB}, g AS (SELECT * FROM f WHERE source IN (SELECT source FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1))', _COUNTS) + " FROM g")
def crossed_subcorpus(spark, sf_dir):
    return tables.counts(corpora.Corpus.from_frame(D.labels_design(spark, sf_dir), weight="weight").crossed_subcorpus().frame)


@query("regroup", f"""{A} SELECT CASE "group" WHEN 'F' THEN 'closed' ELSE 'open' END AS "group", count(*) AS n_rows, round(sum(weight), 9) AS weight FROM f WHERE "group" <> 'P' GROUP BY 1""")
def regroup(spark, sf_dir):
    c = corpora.Corpus.from_frame(D.orders_design(spark, sf_dir), weight="weight", duplicates="keep").regroup({"F": "closed", "O": "open"})
    return c.frame.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"))


@query("with_source", f"""WITH f AS (SELECT c_nationkey::VARCHAR AS source, c_mktsegment AS "group", l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey) SELECT source, "group", round(sum(weight), 9) AS weight FROM f GROUP BY 1, 2""")
def with_source(spark, sf_dir):
    return _segments(spark, sf_dir).with_source("c_nationkey").w


# entropy -----------------------------------------------------------------

_H = W + """, s AS (SELECT source, sum(p) AS n, sum(weight) AS weight, sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS x, count(*) FILTER (p > 0) AS k FROM p GROUP BY 1),
    ps AS (SELECT *, CASE WHEN n > 0 THEN greatest(log2(n) - x / n, 0) * (k > 1)::INT END AS h FROM s),
    g AS (SELECT "group", sum(p) AS t FROM p GROUP BY 1),
    tot AS (SELECT (SELECT -sum(t * log2(t)) FROM g WHERE t > 0) AS hg, (SELECT sum(n * h) FROM ps) AS hc)"""
_ENTROPY = sql_rounded(A + _H, {
    "h_group": "r:hg", "h_group_given_source": "r:hc", "mutual_information": "r:hg - hc", "ratio": "r:hc / hg", "uncertainty_coefficient": "r:1 - hc / hg", "n_sources": "b:(SELECT count(*) FROM ps)",
    "n_spanning_sources": "b:(SELECT count(*) FROM ps WHERE k > 1)", "n_nested_sources": "b:(SELECT count(*) FROM ps WHERE k = 1)", "n_zero_weight_sources": "b:(SELECT count(*) FROM ps WHERE k = 0)",
}) + " FROM tot"


@query("entropy", _ENTROPY)
def label_entropy(spark, sf_dir):
    return entropy.frame_entropy(D.orders_design(spark, sf_dir))


@query("entropy_labels", _ENTROPY.replace(A, LB))
def label_entropy_labels(spark, sf_dir):
    return entropy.frame_entropy(D.labels_design(spark, sf_dir))


@query("entropy_languages", _ENTROPY.replace(A, LC))
def label_entropy_languages(spark, sf_dir):
    return entropy.frame_entropy(D.languages_design(spark, sf_dir))


@query("shannon", f'{A}{W} SELECT source, round(-sum(q * log2(q)), 9) + 0.0 AS h FROM (SELECT source, weight / sum(weight) OVER (PARTITION BY source) AS q FROM w) GROUP BY 1')
def shannon(spark, sf_dir):
    w = tables.source_group_weight(D.orders_design(spark, sf_dir))
    return w.groupBy("source").agg(entropy.shannon(F.col("weight")).alias("h"))


@query("entropy_per_source", sql_rounded(A + _H, {
    "source": "", "weight": "r:weight", "source_probability": "r:n", "n_groups_present": "b:k", "spanning": ":k > 1", "h_given_source": "r:h", "contribution": "r:coalesce(n * h, 0)",
}) + " FROM ps")
def entropy_per_source(spark, sf_dir):
    return entropy.per_source(tables.source_group_weight(D.orders_design(spark, sf_dir)))


_LOSO = _H + """, src AS (SELECT DISTINCT source AS d FROM p),
    lw AS (SELECT d, source, "group", p FROM src JOIN p ON source <> d), ln AS (SELECT d, sum(p) AS n FROM lw GROUP BY 1),
    lg AS (SELECT d, -sum(q * log2(q)) AS hg FROM (SELECT lw.d, sum(p) / max(n) AS q FROM lw JOIN ln USING (d) GROUP BY lw.d, "group") WHERE q > 0 GROUP BY 1),
    lc AS (SELECT lw.d, sum(DISTINCT 0) + sum(contrib) AS hc FROM (SELECT DISTINCT d, source FROM lw) lw JOIN (SELECT source, n * h AS contrib FROM ps) c USING (source) GROUP BY 1),
    lo AS (SELECT d, hg, hc / n AS hc, hc / n / hg AS r, tot.hc / tot.hg AS base FROM (SELECT lg.d, lg.hg, lc.hc, ln.n FROM lg JOIN lc USING (d) JOIN ln USING (d)) x, (SELECT hg, hc FROM tot) tot)"""
_LOSO = _LOSO.replace("lo AS (SELECT d, hg, hc / n AS hc, hc / n / hg AS r,", "lo AS (SELECT d, x.hg, x.hc / n AS hc, x.hc / n / x.hg AS r,")


@query("entropy_loso", sql_rounded(LB + _LOSO, {
    "source": ":d", "ratio_without": "r:r", "delta_ratio": "r:r - base", "abs_delta_ratio": "r:abs(r - base)", "pct_change": "r:100 * (r - base) / base", "h_group_without": "r:lo.hg",
    "h_group_given_source_without": "r:lo.hc", "original_contribution": "r:coalesce(n * h, 0)",
}) + " FROM lo JOIN ps ON lo.d = ps.source")
def entropy_loso(spark, sf_dir):
    return entropy.leave_one_source_out(tables.source_group_weight(D.labels_design(spark, sf_dir)))


@query("bootstrap")
def bootstrap(spark, sf_dir):
    w = tables.source_group_weight(D.labels_design(spark, sf_dir))
    draws = entropy.bootstrap_draws(w, 2000, seed=7)
    pick = lambda p: F.percentile("ratio", F.lit(p))
    return draws.agg(pick(0.025).alias("lower"), pick(0.5).alias("median"), pick(0.975).alias("upper"), F.count("ratio").alias("n_effective"), F.count_if(F.col("ratio").isNull()).alias("n_degenerate"))


# ceiling -----------------------------------------------------------------

_CEIL = """, t AS (SELECT source, coalesce(sum(weight) FILTER ("group" = '{pos}'), 0) AS pos, coalesce(sum(weight) FILTER ("group" <> '{pos}'), 0) AS neg FROM f GROUP BY 1),
    l AS (SELECT pos / (pos + neg) AS q, (pos + neg) / sum(pos + neg) OVER () AS c FROM t WHERE pos + neg > 0), pi AS (SELECT sum(c * q) AS pi FROM l),
    cand AS (SELECT DISTINCT q FROM l UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
    pts AS (SELECT cand.q, sum(c * least(cand.q, l.q)) / max(pi) AS sens, sum(c * least(1 - cand.q, 1 - l.q)) / (1 - max(pi)) AS spec FROM cand, l, pi GROUP BY cand.q),
    best AS (SELECT q, sens, spec, (sens + spec) / 2 AS acc FROM pts ORDER BY round((sens + spec) / 2, 12) DESC, q LIMIT 1),
    kap AS (SELECT sum(pos * neg / (pos + neg)) / sum(pos) AS kp, sum(pos * neg / (pos + neg)) / sum(neg) AS kn, sum(pos) / sum(pos + neg) AS prior, sum(pos + neg) AS total, count(*) AS n FROM t)"""
_CEIL_COLUMNS = {
    "exact": "r:acc", "q_star": "r:q", "sensitivity": "r:sens", "specificity": "r:spec", "relaxation": "r:0.5 + (kp + kn) / 2", "excess_over_chance": "r:acc - 0.5",
    "relaxation_slack": "r:CASE WHEN acc > 0.5 THEN (kp + kn) / 2 / (acc - 0.5) - 1 END", "kappa_positive": "r:kp", "kappa_negative": "r:kn", "prior_positive": "r:prior", "total_weight": "r:total",
    "n_sources": "b:n", "n_zero_weight_sources": "b:0",
}


@query("ceiling", sql_rounded(B2 + _CEIL.format(pos="F"), _CEIL_COLUMNS | {"positive_group": ":'F'", "negative_group": ":'O'"}) + " FROM best, kap")
def balanced_accuracy_ceiling(spark, sf_dir):
    return ceiling.balanced_accuracy_ceiling(tables.source_group_weight(D.orders_design(spark, sf_dir, binary=True)))


@query("ceiling_labels", sql_rounded(LB + _CEIL.format(pos="1"), _CEIL_COLUMNS | {"positive_group": ":'1'", "negative_group": ":'0'"}) + " FROM best, kap")
def ceiling_labels(spark, sf_dir):
    return ceiling.balanced_accuracy_ceiling(tables.source_group_weight(D.labels_design(spark, sf_dir)), positive="1")


@query("kappas", sql_rounded(LB + _CEIL.format(pos="0"), {k: _CEIL_COLUMNS[k] for k in ("kappa_positive", "kappa_negative", "prior_positive", "total_weight", "n_sources", "n_zero_weight_sources")}) + " FROM kap")
def kappas(spark, sf_dir):
    return ceiling.kappas(ceiling.binary_table(tables.source_group_weight(D.labels_design(spark, sf_dir)))[0])


_MASSES = (0.0, 1.0, 5.0, 40.0, 1000.0)
_SENS = f"""{LB}, t0 AS (SELECT source, coalesce(sum(weight) FILTER ("group" = '0'), 0) AS pos, coalesce(sum(weight) FILTER ("group" = '1'), 0) AS neg FROM f GROUP BY 1),
    m AS (SELECT unnest([{", ".join(f"{m}::DOUBLE" for m in _MASSES)}]) AS mass),
    t AS (SELECT mass, source, pos * k AS pos, neg * k AS neg FROM (SELECT *, CASE WHEN source = 'src1' THEN mass / (pos + neg) ELSE 1 END AS k FROM t0, m)),
    l AS (SELECT mass, pos / (pos + neg) AS q, (pos + neg) / sum(pos + neg) OVER (PARTITION BY mass) AS c FROM t WHERE pos + neg > 0), pi AS (SELECT mass, sum(c * q) AS pi FROM l GROUP BY 1),
    cand AS (SELECT DISTINCT mass, q FROM l UNION SELECT mass, 0.0::DOUBLE FROM m UNION SELECT mass, 1.0::DOUBLE FROM m),
    pts AS (SELECT mass, cand.q, sum(c * least(cand.q, l.q)) / max(pi) AS sens, sum(c * least(1 - cand.q, 1 - l.q)) / (1 - max(pi)) AS spec FROM cand JOIN l USING (mass) JOIN pi USING (mass) GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, (sens + spec) / 2 AS acc, row_number() OVER (PARTITION BY mass ORDER BY round((sens + spec) / 2, 12) DESC, q) AS nth FROM pts) WHERE nth = 1),
    kap AS (SELECT mass, sum(CASE WHEN pos + neg > 0 THEN pos * neg / (pos + neg) END) / sum(pos) AS kp, sum(CASE WHEN pos + neg > 0 THEN pos * neg / (pos + neg) END) / sum(neg) AS kn, sum(pos) / sum(pos + neg) AS prior,
    sum(pos + neg) AS total, count(*) AS n, count(*) FILTER (pos + neg <= 0) AS z FROM t GROUP BY 1)"""


@query("ceiling_sensitivity", sql_rounded(_SENS, {"mass": ":mass", "share_of_total_weight": "r:mass / total"} | _CEIL_COLUMNS | {"n_zero_weight_sources": "b:z"}) + " FROM best JOIN kap USING (mass)")
def ceiling_sensitivity(spark, sf_dir):
    return ceiling.ceiling_sensitivity(tables.source_group_weight(D.labels_design(spark, sf_dir)), "src1", _MASSES)


# structure ---------------------------------------------------------------


def _some_orders(spark, sf_dir):
    return D.labels_design(spark, sf_dir)


@query("shared_source_pairs", f"{LB}{EDGES} SELECT a.unit AS unit_a, b.unit AS unit_b, count(*) AS n_shared FROM e a JOIN e b USING (source) WHERE a.unit < b.unit GROUP BY 1, 2")
def shared_source_pairs(spark, sf_dir):
    return structure.shared_source_pairs(_some_orders(spark, sf_dir))


_ORDERED = 'ug AS (SELECT DISTINCT unit, "group" FROM f), deg AS (SELECT unit, count(*) AS k FROM e GROUP BY 1)'
_PAIRS = """pr AS (SELECT DISTINCT a.unit AS u, b.unit AS v FROM e a JOIN e b USING (source) WHERE a.unit < b.unit),
    pg AS (SELECT a."group" AS ga, b."group" AS gb FROM pr JOIN ug a ON u = a.unit JOIN ug b ON v = b.unit)"""
_GROUPS = """gs AS (SELECT ug."group", count(*) AS n_units, avg(k) AS m, max(k) AS mx, count(*) FILTER (k = 1) AS ones FROM ug JOIN deg USING (unit) GROUP BY 1),
    gn AS (SELECT "group", count(DISTINCT source) AS n_sources FROM f GROUP BY 1), sh AS (SELECT ga AS "group", count(*) AS n FROM pg WHERE ga = gb GROUP BY 1),
    psg AS (SELECT "group", n_units, n_units * (n_units - 1) // 2 AS n_pairs, coalesce(n, 0) AS sharing, n_sources, m, mx, ones FROM gs JOIN gn USING ("group") LEFT JOIN sh USING ("group"))"""
_PSG = {
    "group": ':"group"', "n_units": "b:n_units", "sources_per_unit_mean": "r:m", "sources_per_unit_max": "b:mx", "units_with_one_source": "b:ones", "n_sources": "b:n_sources",
    "n_pairs_sharing": "b:sharing", "n_pairs": "b:n_pairs", "pair_sharing_rate": "r:CASE WHEN n_pairs > 0 THEN sharing / n_pairs END",
}


@query("pair_sharing", sql_rounded(f"{A}{EDGES}, {_ORDERED}, {_PAIRS}, {_GROUPS}", _PSG) + " FROM psg")
def pair_sharing(spark, sf_dir):
    return structure.pair_sharing_by_group(D.orders_design(spark, sf_dir))


@query("pair_sharing_labels", sql_rounded(f"{LB}{EDGES}, {_ORDERED}, {_PAIRS}, {_GROUPS}", _PSG) + " FROM psg")
def pair_sharing_labels(spark, sf_dir):
    return structure.pair_sharing_by_group(D.labels_design(spark, sf_dir))


@query("structural_loso", f"""{A}{EDGES}, {_ORDERED} SELECT source, count(*) AS units_covered, count(*) FILTER (k = 1) AS emptied_total,
    array_to_string(list_sort(coalesce(list(unit) FILTER (k = 1), [])), ',') AS emptied_unit_keys FROM e JOIN deg USING (unit) GROUP BY 1""")
def structural_loso(spark, sf_dir):
    return structure.source_removal(D.orders_design(spark, sf_dir)).withColumn("emptied_unit_keys", F.array_join("emptied_unit_keys", ","))


_BY_GROUP = f"""{EDGES}, {_ORDERED}, sz AS (SELECT "group", count(*) AS size FROM ug GROUP BY 1),
    rg AS (SELECT source, "group", count(*) AS covers, count(*) FILTER (k = 1) AS emptied FROM e JOIN deg USING (unit) JOIN ug USING (unit) GROUP BY 1, 2)"""


@query("structural_loso_by_group", sql_rounded(A + _BY_GROUP, {"source": "", "group": ':"group"', "covers": "b:covers", "emptied": "b:emptied", "frac_emptied": "r:emptied / size"}) + ' FROM rg JOIN sz USING ("group")')
def structural_loso_by_group(spark, sf_dir):
    return structure.source_removal_by_group(D.orders_design(spark, sf_dir))


@query("worst_removals", sql_rounded(A + _BY_GROUP + """, rk AS (SELECT source, "group", emptied / size AS fr, row_number() OVER (PARTITION BY "group" ORDER BY emptied / size DESC, source) AS nth
    FROM rg JOIN sz USING ("group"))""", {"group": ':"group"', "worst_removal_fraction": "r:fr", "worst_removal_source": ":source"}) + " FROM rk WHERE nth = 1")  # fmt: skip
def worst_removals(spark, sf_dir):
    return structure.worst_removals(D.orders_design(spark, sf_dir))


@query("spanning_source_table", f"""{LB} SELECT source, count(*) AS n_rows, count(DISTINCT "group") AS n_groups, array_to_string(list_sort(list(DISTINCT "group")), ', ') AS groups,
    count(DISTINCT unit) AS n_units, array_to_string(list_sort(list(DISTINCT unit)), ', ') AS units FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1""")
def spanning_source_table(spark, sf_dir):
    return structure.spanning_source_table(D.labels_design(spark, sf_dir))


_CONC = """tp AS (SELECT source, count(*) AS k FROM e GROUP BY 1 ORDER BY k DESC, source LIMIT 1), pa AS (SELECT count(*) AS n FROM pr),
    pw AS (SELECT count(*) AS n FROM (SELECT DISTINCT a.unit, b.unit FROM e a JOIN e b USING (source) WHERE a.unit < b.unit AND source <> (SELECT source FROM tp))),
    cc AS (SELECT (SELECT count(DISTINCT unit) FROM e) AS u, pa.n AS sharing, pw.n AS without, tp.source AS top, tp.k AS k, (SELECT count(*) FROM (SELECT source FROM e GROUP BY 1 HAVING count(*) > 1)) AS multi FROM pa, pw, tp)"""
_CONC_COLUMNS = {
    "n_pairs": "b:u * (u - 1) // 2", "n_pairs_sharing": "b:sharing", "pair_sharing_rate": "r:sharing / (u * (u - 1) / 2)", "top_source": ":top", "top_source_units": "b:k",
    "top_source_pairs": "b:k * (k - 1) // 2", "top_source_share_of_sharing": "r:(k * (k - 1) // 2) / sharing", "n_pairs_sharing_without_top": "b:without",
    "share_of_sharing_lost_without_top": "r:(sharing - without) / sharing", "n_sources_feeding_multiple_units": "b:multi",
}


@query("concentration", sql_rounded(f"{A}{EDGES}, {_ORDERED}, {_PAIRS}, {_CONC}", {"n_units": "b:u"} | _CONC_COLUMNS) + " FROM cc")
def concentration(spark, sf_dir):
    return structure.concentration(D.orders_design(spark, sf_dir))


_SUMMARY = f"""{LB}{EDGES}{_DUPS}, {_ORDERED}, {_PAIRS}, {_GROUPS}, {_CONC}, s AS (SELECT source, count(*) AS n FROM e GROUP BY 1), sp AS (SELECT source FROM f GROUP BY 1 HAVING count(DISTINCT "group") > 1),
    ff AS (SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT unit) AS n_units, count(DISTINCT "group") AS n_groups, sum(weight) AS total FROM f),
    rt AS (SELECT min(sharing / n_pairs) AS mn, max(sharing / n_pairs) AS mx, count(*) AS k, sum(n_pairs) AS wp, sum(sharing) AS ws FROM psg WHERE n_pairs > 0),
    ms AS (SELECT count(*) AS r, coalesce(sum(weight), 0) AS w FROM f WHERE source IN (SELECT source FROM sp))"""


@query("design_summary", sql_rounded(_SUMMARY, {
    "n_rows": "b:n_rows", "n_sources": "b:n_sources", "n_units": "b:n_units", "n_groups": "b:n_groups", "total_weight": "r:total", "n_duplicate_keys": "b:(SELECT count(*) FROM k)",
    "n_duplicate_rows": "b:(SELECT coalesce(sum(n - 1), 0) FROM k)", "units_per_source_median": "r:(SELECT median(n) FROM s)", "units_per_source_max": "b:(SELECT max(n) FROM s)",
    "sources_per_unit_median": "r:(SELECT median(k) FROM deg)", "sources_per_unit_max": "b:(SELECT max(k) FROM deg)", "units_with_one_source": "b:(SELECT count(*) FROM deg WHERE k = 1)",
    "n_spanning_sources": "b:(SELECT count(*) FROM sp)",
} | _CONC_COLUMNS | {
    "pair_sharing_rate_min": "r:mn", "pair_sharing_rate_max": "r:mx", "pair_sharing_rate_gap": "r:CASE WHEN rt.k > 1 THEN mx - mn END", "rows_in_spanning_sources": "b:ms.r", "weight_in_spanning_sources": "r:ms.w",
    "n_cross_group_pairs": "b:u * (u - 1) // 2 - wp", "n_cross_group_pairs_sharing": "b:sharing - ws", "cross_group_pair_sharing_rate": "r:(sharing - ws) / nullif(u * (u - 1) // 2 - wp, 0)",
}).replace('"top_source_units"', '"top_source_units"').replace("(k)::BIGINT AS", "(cc.k)::BIGINT AS").replace("(k * (k - 1) // 2)", "(cc.k * (cc.k - 1) // 2)") + " FROM ff, cc, rt, ms")
def design_summary(spark, sf_dir):
    return structure.design_summary(D.labels_design(spark, sf_dir))


# guards ------------------------------------------------------------------

_V = W + """, rr AS (SELECT source, sum(p) AS r FROM p WHERE p > 0 GROUP BY 1), ccol AS (SELECT "group", sum(p) AS c FROM p WHERE p > 0 GROUP BY 1),
    ph AS (SELECT greatest(sum(p * p / (r * c)) - 1, 0) AS phi2 FROM p JOIN rr USING (source) JOIN ccol USING ("group")),
    sh2 AS (SELECT (SELECT count(*) FROM rr) AS r, (SELECT count(*) FROM ccol) AS c, (SELECT sum(weight) FROM w) AS n),
    vv AS (SELECT sqrt(phi2 / (least(r, c) - 1)) AS v, sqrt(greatest(0, phi2 - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)) - 1)) AS vb FROM ph, sh2)"""


@query("cramers_v", sql_rounded(A + _V, {"cramers_v": "r:v"}) + " FROM vv")
def cramers_v(spark, sf_dir):
    return guards.cramers_v(tables.source_group_weight(D.orders_design(spark, sf_dir))).select("cramers_v")


@query("cramers_v_bc", sql_rounded(LB + _V, {"cramers_v_bc": "r:vb"}) + " FROM vv")
def cramers_v_bc(spark, sf_dir):
    return guards.cramers_v(tables.source_group_weight(D.labels_design(spark, sf_dir))).select("cramers_v_bc")


@query("theils_u", sql_rounded(A + _H, {"theils_u": "r:1 - hc / hg"}) + " FROM tot")
def theils_u(spark, sf_dir):
    return guards.theils_u(tables.source_group_weight(D.orders_design(spark, sf_dir)))


@query("min_batch_size", f"{LB} SELECT source, count(DISTINCT unit) AS n_units FROM f GROUP BY 1")
def min_batch_size(spark, sf_dir):
    return guards.min_batch_size(D.labels_design(spark, sf_dir))


_RANK = """, sg AS (SELECT DISTINCT source, "group" FROM f), reach AS (WITH RECURSIVE r(a, b) AS (SELECT DISTINCT "group", "group" FROM sg UNION SELECT r.a, y."group" FROM r JOIN sg x ON r.b = x."group"
    JOIN sg y ON x.source = y.source) SELECT a, min(b) AS root FROM r GROUP BY 1),
    rk AS (SELECT count(*) AS n_rows, count(DISTINCT source) AS s, count(DISTINCT "group") AS g, (SELECT count(DISTINCT root) FROM reach) AS k FROM f),
    bs AS (SELECT min(n) AS mn, count(*) FILTER (n <= 1) AS ones FROM (SELECT count(DISTINCT unit) AS n FROM f GROUP BY source))"""


@query("design_rank", sql_rounded(LB + _RANK, {
    "design_rank": "b:s + g - k", "design_columns": "b:s + g - 1", "rank_deficient": ":s + g - k < s + g - 1", "n_rows": "b:n_rows", "n_sources": "b:s", "n_groups": "b:g", "min_batch_size": "b:mn",
    "n_singleton_sources": "b:ones",
}) + " FROM rk, bs")
def design_rank(spark, sf_dir):
    return guards.design_rank(D.labels_design(spark, sf_dir))


_GUARD = LB + _H + _V.removeprefix(W) + _RANK + _CEIL.format(pos="0").replace("best AS", "bst AS").replace("kap AS", "kp AS")
_GUARD_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS name, round(({v})::DOUBLE, 9) + 0.0 AS value, ({t})::DOUBLE AS threshold, {f} AS fires FROM tot, vv, rk, bs, bst"
    for n, v, t, f in [
        ("cramers_v", "v", "1", "abs(v - 1) <= 1e-12"), ("cramers_v_bias_corrected", "vb", "1", "abs(vb - 1) <= 1e-12"), ("theils_u", "1 - hc / hg", "1", "abs(hc / hg) <= 1e-12"),
        ("design_rank", "rk.s + rk.g - rk.k", "rk.s + rk.g - 1", "rk.k > 1"), ("min_batch_size", "mn", "1", "mn <= 1"), ("residual_entropy_ratio", "hc / hg", "0", "abs(hc / hg) <= 1e-12"),
        ("balanced_accuracy_ceiling", "acc", "0.5", "acc <= 0.5 + 1e-12"),
    ]
)


@query("guard_report", f"{_GUARD} {_GUARD_ROWS}")
def guard_report(spark, sf_dir):
    return guards.guard_report(D.labels_design(spark, sf_dir))


# grains ------------------------------------------------------------------

_GRAINS = {"supplier": "l_suppkey", "customer": "c_custkey", "nation": "c_nationkey", "supplier_in_nation": ("c_nationkey", "l_suppkey")}
_GRAIN_SQL = {"supplier": "l_suppkey", "customer": "c_custkey", "nation": "c_nationkey", "supplier_in_nation": "c_nationkey || '/' || l_suppkey"}
_SWEEP = """WITH b AS (SELECT l_suppkey::VARCHAR AS l_suppkey, c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, o_orderkey::VARCHAR AS unit, c_mktsegment AS "group",
    l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), f AS (""" + " UNION ALL ".join(
    f"""SELECT '{k}' AS grain, {v} AS source, unit, "group", weight FROM b""" for k, v in _GRAIN_SQL.items()
) + """), w AS (SELECT grain, source, "group", sum(weight) AS weight FROM f GROUP BY ALL), p AS (SELECT *, weight / sum(weight) OVER (PARTITION BY grain) AS p FROM w),
    s AS (SELECT grain, source, sum(p) AS n, sum(p * log2(p)) AS x, count(*) AS k FROM p GROUP BY 1, 2),
    c AS (SELECT grain, sum(CASE WHEN k > 1 THEN greatest(n * log2(n) - x, 0) ELSE 0 END) AS hc, count(*) AS ns, count(*) FILTER (k > 1) AS sp, count(*) FILTER (k = 1) AS ne FROM s GROUP BY 1),
    g AS (SELECT grain, -sum(t * log2(t)) AS hg FROM (SELECT grain, sum(p) AS t FROM p GROUP BY grain, "group") GROUP BY 1),
    n AS (SELECT grain, count(*) AS r, count(DISTINCT unit) AS u, count(DISTINCT "group") AS gr FROM f GROUP BY 1)"""


@query("grain_sweep", sql_rounded(_SWEEP, {
    "grain": "", "n_sources": "b:ns", "n_spanning_sources": "b:sp", "n_nested_sources": "b:ne", "n_zero_weight_sources": "b:0", "h_group": "r:hg", "h_group_given_source": "r:hc", "ratio": "r:hc / hg",
    "uncertainty_coefficient": "r:1 - hc / hg", "n_rows": "b:r", "n_units": "b:u", "n_groups": "b:gr", "degeneracy": ":''",
}) + " FROM c JOIN g USING (grain) JOIN n USING (grain)")
def grain_sweep(spark, sf_dir):
    return grain.score_grains(D.segments_records(spark, sf_dir), _GRAINS, unit="o_orderkey", group="c_mktsegment", weight="l_quantity")


@query("grain_sweep_corpus", _SQL["grain_sweep"])
def grain_sweep_corpus(spark, sf_dir):
    return grain.grain_sweep(_segments(spark, sf_dir), _GRAINS)
