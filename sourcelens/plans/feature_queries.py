"""Queries over profiles, split nulls, simulations and column audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelens.operators import calibration, design, metrics
from sourcelens.plans import designs as D
from sourcelens.plans.design_queries import rounded
from sourcelens.sources import audits, names

_QUERIES = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 9):
    """Registers a query with its SQL; without digits it rounds its doubles itself."""

    def add(f):
        _QUERIES[name] = f if digits is None else lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            _SQL[name] = sql
        return f

    return add


def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the shares of their event types: one block of a composition."""
    e = D.read(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    share = [F.avg((F.col("event_type") == k).cast("double")) for k in kinds]
    return e.groupBy(F.col("user_id").cast("string").alias("unit")).agg(F.array(F.array(*share)).alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as profiles of one block."""
    return metrics.profiles(D.read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below 5 are one side, all others the other."""
    e = D.read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("unit"), F.when(F.col("label") < 5, "a").otherwise("b").alias("side"))


_SHARES = """WITH k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT user_id::VARCHAR AS unit, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT unit, sum(n) AS t FROM u GROUP BY 1), x AS (SELECT t.unit, k.event_type AS c, coalesce(u.n, 0)::DOUBLE / t AS v FROM t CROSS JOIN k LEFT JOIN u ON u.unit = t.unit AND u.event_type = k.event_type),
    pr AS (SELECT a.unit AS i, b.unit AS j, a.c, a.v AS p, b.v AS q FROM x a JOIN x b ON a.c = b.c WHERE a.unit < b.unit)"""


def _geometry(distance: str, inner: str = "pr") -> str:
    return f"""{_SHARES}, d AS (SELECT i, j, {distance} AS d FROM {inner} GROUP BY 1, 2) SELECT i, j, round(d, 6) + 0.0 AS distance, round(-d, 6) + 0.0 AS similarity FROM d"""


_OVERLAP = "least(greatest(sum(sqrt(p * q)), 0), 1)"
_DISTANCES = {
    "fisher_rao": f"2 * acos({_OVERLAP})", "hellinger": f"sqrt(1 - {_OVERLAP})",
    "jensen_shannon": "sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0))",
    "euclidean": "sqrt(sum((p - q) * (p - q)))",
}
for _name, _distance in _DISTANCES.items():
    query(_name, _geometry(_distance), None)(lambda spark, sf_dir, f=metrics.METRICS[_name]: f(event_shares(spark, sf_dir), digits=6))

_CLR = """, e AS (SELECT unit, c, (v + {eps}) / sum(v + {eps}) OVER (PARTITION BY unit) AS v FROM x), l AS (SELECT unit, c, ln(v) - avg(ln(v)) OVER (PARTITION BY unit) AS v FROM e),
    pl AS (SELECT a.unit AS i, b.unit AS j, a.c, a.v AS p, b.v AS q FROM l a JOIN l b ON a.c = b.c WHERE a.unit < b.unit)"""


def _aitchison_sql(eps: float) -> str:
    return _geometry("sqrt(sum((p - q) * (p - q)))", "pl").replace(_SHARES, _SHARES + _CLR.format(eps=eps), 1)


@query("aitchison", _aitchison_sql(0.5), None)
def aitchison(spark, sf_dir):
    return metrics.aitchison(event_shares(spark, sf_dir), eps=0.5, digits=6)


_VECTORS = """WITH e AS (SELECT vec_id::VARCHAR AS unit, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label, generate_subscripts(embedding, 1) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings),
    z AS (SELECT unit, label, c, v - avg(v) OVER (PARTITION BY unit) AS v FROM e), s AS (SELECT unit, label, c, v / sqrt(sum(v * v) OVER (PARTITION BY unit)) AS v FROM z),
    pr AS (SELECT a.unit AS i, b.unit AS j, a.label AS li, b.label AS lj, least(greatest(sum(a.v * b.v), -1), 1) AS r FROM s a JOIN s b ON a.c = b.c WHERE a.unit < b.unit GROUP BY 1, 2, 3, 4)"""


@query("pearson", f"{_VECTORS} SELECT i, j, round(sqrt(1 - r), 6) AS distance, round(r, 6) + 0.0 AS similarity FROM pr", None)
def pearson(spark, sf_dir):
    return metrics.pearson(vectors(spark, sf_dir), digits=6)


@query("dispersion_gap", f"{_VECTORS} SELECT round(abs(avg(r) FILTER (li = 0 AND lj = 0) - avg(r) FILTER (li = 1 AND lj = 1)), 9) AS gap FROM pr")
def dispersion_gap(spark, sf_dir):
    return calibration.gap_of(metrics.unit_vectors(vectors(spark, sf_dir)), _members(spark, sf_dir))


@query("named_split", f"{_VECTORS} SELECT round(avg(r) FILTER (li = 0 AND lj = 0) - avg(r) FILTER (li = 1 AND lj = 1), 9) + 0.0 AS gap FROM pr")
def named_split(spark, sf_dir):
    labels = _members(spark, sf_dir).withColumnRenamed("side", "label")
    return calibration.named_split(metrics.unit_vectors(vectors(spark, sf_dir)), labels, "a", "b")


_K = f"""{_VECTORS}, both2 AS (SELECT i AS unit, li AS l, lj AS m, r FROM pr UNION ALL SELECT j, lj, li, r FROM pr), c AS (SELECT unit, l, avg(r) AS c FROM both2 WHERE l = m GROUP BY 1, 2),
    sd AS (SELECT stddev_samp(c) FILTER (l = 0) AS a, stddev_samp(c) FILTER (l = 1) AS b FROM c)"""


@query("k_diagnostic", f"""{_K} SELECT round(a, 9) AS sd_a, round(b, 9) AS sd_b, round(b / a, 9) AS k, CASE WHEN b / a < 0.9 THEN 'conservative' WHEN b / a > 1.1 THEN 'anti-conservative' ELSE 'undetermined' END AS verdict,
    CASE WHEN b / a < 0.9 THEN 'upper' WHEN b / a > 1.1 THEN 'lower' ELSE 'undetermined' END AS p_bound FROM sd""")
def k_diagnostic(spark, sf_dir):
    member = _members(spark, sf_dir)
    n = {r.side: r["count"] for r in member.groupBy("side").count().collect()}
    return calibration.k_diagnostic(metrics.unit_vectors(vectors(spark, sf_dir)), member, calibration.KBreakEven(0.9, 1.1, n["a"], n["b"]))


_AGREE_NAMES = ["euclidean", "fisher_rao", "hellinger", "jensen_shannon"]


@query("metric_agreement", f"""{_SHARES}, d AS ({" UNION ALL ".join(f"SELECT '{n}' AS m, i, j, round({_DISTANCES[n]}, 12) AS v FROM pr GROUP BY i, j" for n in _AGREE_NAMES)}),
    r AS (SELECT m, i, j, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2 AS rk FROM d)
    SELECT x.m AS a, y.m AS b, round(corr(x.rk, y.rk), 6) AS spearman FROM r x JOIN r y USING (i, j) GROUP BY 1, 2""", 6)
def metric_agreement(spark, sf_dir):
    return metrics.metric_agreement(event_shares(spark, sf_dir), _AGREE_NAMES)


_EPS = (0.01, 0.1, 1.0)


@query("aitchison_sweep", " UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, true AS per_block, round(avg(distance), 5) AS mean_distance FROM ({_aitchison_sql(e).replace('round(d, 6) + 0.0 AS distance', 'd AS distance')})" for e in _EPS), 5)
def aitchison_sweep(spark, sf_dir):
    return metrics.aitchison_pseudocount_sweep(event_shares(spark, sf_dir), _EPS, per_block=(True,))


def _label_means(spark, sf_dir):
    """Similarities of the labels' mean embeddings: few enough units to list every partition, made from all embeddings."""
    each = D.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("c", "v"))
    mean = each.groupBy("label", "c").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("mean"))
    return metrics.pearson(metrics.profiles(mean, "label", "mean"))


_MEANS = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), e AS (SELECT label, c, avg(v) AS v FROM x GROUP BY 1, 2),
    ids AS (SELECT label, row_number() OVER (ORDER BY label::VARCHAR) - 1 AS k FROM (SELECT DISTINCT label FROM embeddings)),
    z AS (SELECT label, c, v - avg(v) OVER (PARTITION BY label) AS v FROM e), s AS (SELECT ids.k, c, v / sqrt(sum(v * v) OVER (PARTITION BY z.label)) AS v FROM z JOIN ids USING (label)),
    pr AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS r FROM s a JOIN s b ON a.c = b.c WHERE a.k < b.k GROUP BY 1, 2),
    every AS (SELECT unnest(range((1::BIGINT << count(*)))) AS mask FROM ids), m AS (SELECT mask FROM every WHERE bit_count(mask) = 4),
    g AS (SELECT mask, abs(avg(r) FILTER ((mask >> i) & 1 = 1 AND (mask >> j) & 1 = 1) - avg(r) FILTER ((mask >> i) & 1 = 0 AND (mask >> j) & 1 = 0)) AS gap FROM m CROSS JOIN pr GROUP BY 1)"""


@query("split_null", f"{_MEANS} SELECT count(*) AS n_evaluated, round(max(gap), 9) AS maximum, round(avg(gap), 9) AS mean, count(*) FILTER (gap >= 0.05) AS n_reaching FROM g")
def split_null(spark, sf_dir):
    stats, _ = calibration.null_statistics(_label_means(spark, sf_dir), 4)
    return stats.agg(F.count(F.lit(1)).alias("n_evaluated"), F.max("gap").alias("maximum"), F.avg("gap").alias("mean"), F.count_if(F.col("gap") >= 0.05).alias("n_reaching"))


def _halves(spark, sf_dir):
    """All embeddings as vectors whose products are their similarities, and half their number."""
    p = vectors(spark, sf_dir)
    return metrics.unit_vectors(p), p.count() // 2


@query("split_null_sampled")
def split_null_sampled(spark, sf_dir):
    stats, _ = calibration.null_statistics(*_halves(spark, sf_dir), samples=20_000, seed=3)
    return stats.agg(F.count(F.lit(1)).alias("n_evaluated"), F.max("gap").alias("maximum"), F.median("gap").alias("median"))


# simulation ------------------------------------------------------------------


@query("simulate_corpus")
def simulate_corpus(spark, sf_dir):
    return design.simulated_frame(spark, 60, 30, 0.3, seed=5, dispersion=0.5)


@query("design_curve")
def design_curve(spark, sf_dir):
    return design.design_curve(spark, 30, 15, [0.0, 0.25, 0.5, 1.0], replicates=50, seed=1)


@query("envelope")
def envelope(spark, sf_dir):
    return design.simulated_ceiling_envelope(spark, replicates=20, seed=2)


@query("min_crossing")
def min_crossing(spark, sf_dir):
    return design.minimum_viable_crossing(spark, 0.7, (20,), (10, 20), replicates=20, seed=3)


@query("estimator_behavior")
def estimator_behavior(spark, sf_dir):
    return design.estimator_behavior(spark, 0.4, (5, 20), (20, 50), replicates=30, seed=4, reference=(100, 100), calibration_points=11, calibration_rep=5, reference_rep=20)


@query("operating_characteristic")
def operating_characteristic(spark, sf_dir):
    return design.operating_characteristic(spark, n_designs=200, seed=5)


# audits --------------------------------------------------------------------


def _audit_sql(c: str) -> str:
    t = f"{c}::VARCHAR"
    num3 = f"regexp_extract_all({t}, '\\d[\\d,]{{2,}}')"
    return f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER (regexp_matches({t}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')) AS n_direct_numeric,
        count(*) FILTER (len({num3}) > 0) AS n_with_number, count(*) FILTER (len(regexp_extract_all({t}, '\\d[\\d,]*')) > 1) AS n_multi_number FROM customer"""


@query("numeric_audit", " UNION ALL ".join(map(_audit_sql, ["c_custkey", "c_mktsegment", "c_nationkey"])))
def numeric_audit(spark, sf_dir):
    out = audits.numeric_audit(D.read(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"])
    return out.select("column", "n", "n_missing", "n_direct_numeric", "n_with_number", "n_multi_number")


def _profile_sql(c: str) -> str:
    t = f"{c}::VARCHAR"
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_missing, count(DISTINCT {t}) AS n_unique, round(count(DISTINCT {t}) / count({t}), 9) AS frac_unique, round(median(length({t})), 9) AS median_len,
        round(avg(regexp_matches({t}, '^([A-Za-z]{{1,8}}[-_]?\\d{{3,}}(\\.\\d+)?|[A-Za-z]{{1,8}}(-[A-Za-z0-9]{{1,8}})+-\\d{{2,}})$')::INT), 9) AS frac_accession_like FROM documents"""


@query("column_profile", " UNION ALL ".join(map(_profile_sql, ["doc_id", "lang", "source"])))
def column_profile(spark, sf_dir):
    out = audits.column_profile(D.read(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    return out.select("column", "n_missing", "n_unique", "frac_unique", "median_len", "frac_accession_like")


@query("parse_run_names", """SELECT 'run_' || l_suppkey || '_' || l_orderkey || '.raw' AS name, 'run_' || l_suppkey || '_' || l_orderkey AS run, l_suppkey::VARCHAR AS source, l_orderkey::VARCHAR AS unit, 3 AS n_tokens
    FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)""")
def parse_run_names(spark, sf_dir):
    rows = D.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().select(F.concat(F.lit("run_"), "l_suppkey", F.lit("_"), "l_orderkey", F.lit(".raw")).alias("name"))
    return names.parse_run_names(rows, {"source": 1, "unit": -1})


@query("check_recoverability")
def check_recoverability(spark, sf_dir):
    rows = D.read(spark, sf_dir, "documents").drop("text").join(D.read(spark, sf_dir, "labels"), "doc_id")
    return audits.check_recoverability(rows, source="source", unit="doc_id", group="quality", weight="n_chars")


@query("infer_columns")
def infer_columns(spark, sf_dir):
    found = audits.infer_columns(D.read(spark, sf_dir, "documents").drop("text"))
    return spark.createDataFrame([(r, i, c) for r, cs in found.items() for i, c in enumerate(cs)], "role string, place int, column string")


@query("median_split")
def median_split(spark, sf_dir):
    users = D.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    v = users.orderBy("user_id").select("n").toArrow()["n"].to_numpy()
    return calibration.median_split_table(spark, v)


@query("null_histogram")
def null_histogram(spark, sf_dir):
    r = calibration.arbitrary_split_null(*_halves(spark, sf_dir), bins=20, observed=0.05, samples=20_000)
    rows = spark.createDataFrame([(int(b), int(k)) for b, k in r.histogram], "bin int, n long")
    return rows.withColumn("cumulative", F.sum("n").over(Window.orderBy("bin")))
