"""Queries over validation, audit, diagnosis and the core report, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelens.api.config import AnalysisConfig
from sourcelens.api.diagnostics import diagnose, metric_table
from sourcelens.api.validation import assess, validate
from sourcelens.functions.keys import with_row_position
from sourcelens.operators import report
from sourcelens.operators.corpus import Corpus
from sourcelens.plans import design_queries as Q
from sourcelens.plans import designs as D
from sourcelens.plans.design_queries import rounded

_QUERIES = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def _config(columns: dict, **other) -> AnalysisConfig:
    base = {
        "schema_version": "0.1-draft", "name": "driver tables", "columns": columns, "grain": {"name": "supplier", "description": "the supplier of a line item"}, "unit_description": "an order",
    }
    return AnalysisConfig.from_dict(base | other)


_ORDERS = {"source": ["l_suppkey"], "unit": ["l_orderkey"], "group": ["o_orderstatus"]}
_MASS = {"weighting": {"mode": "column", "column": "l_quantity", "description": "ordered quantity"}}


def _orders(spark, sf_dir):
    o = D.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = D.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return with_row_position(rows.orderBy(*rows.columns))


_ROWS = """WITH r AS (SELECT l_suppkey, l_orderkey, l_quantity, o_orderstatus, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_quantity, o_orderstatus) - 1 AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    k AS (SELECT l_suppkey, l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS q, min(pos) AS first FROM r GROUP BY 1, 2),
    x AS (SELECT r.*, k.n, k.q, k.first FROM r JOIN k USING (l_suppkey, l_orderkey))"""


@query("validation_counts", f"""{_ROWS} SELECT count(*) AS n_records, count(*) AS n_key_complete, count(*) AS n_retained, 0::BIGINT AS n_excluded, (SELECT count(*) FROM k WHERE n > 1) AS n_duplicate_keys,
    (SELECT sum(n - 1) FROM k)::BIGINT AS n_duplicate_rows, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT l_orderkey) AS n_units, count(DISTINCT o_orderstatus) AS n_groups,
    round(sum(l_quantity)::DOUBLE, 9) AS total_weight FROM x""")
def validation_counts(spark, sf_dir):
    c = validate(_orders(spark, sf_dir), config=_config(_ORDERS, **_MASS, policies={"duplicates": "keep_records"})).counts
    names = [n for n in c if n != "n_error_records"]
    return spark.createDataFrame([tuple(c[n] for n in names)], ", ".join(f"{n} {'double' if n == 'total_weight' else 'long'}" for n in names))


@query("validation_issue_counts", f"""{_ROWS} SELECT 'duplicate_observation' AS code, 'error' AS severity, count(*) AS n_rows, 'l_suppkey,l_orderkey,o_orderstatus' AS columns FROM x WHERE n > 1
    UNION ALL SELECT 'key_normalized', 'info', count(*), 'l_suppkey' FROM x UNION ALL SELECT 'key_normalized', 'info', count(*), 'l_orderkey' FROM x""")
def validation_issue_counts(spark, sf_dir):
    issues = validate(_orders(spark, sf_dir), config=_config(_ORDERS, **_MASS)).issues
    return spark.createDataFrame([(i.code, i.severity, i.n_rows, ",".join(i.columns)) for i in issues], "code string, severity string, n_rows long, columns string")


_DISTINCT = """WITH r AS (SELECT l_suppkey, l_orderkey, o_orderstatus, row_number() OVER (ORDER BY l_suppkey, l_orderkey, o_orderstatus) - 1 AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    k AS (SELECT l_suppkey, l_orderkey, min(pos) AS first FROM r GROUP BY 1, 2), d AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS dense FROM k)"""


@query("row_audit", f"""{_DISTINCT} SELECT pos AS row_position, CASE WHEN pos = k.first THEN 'retained' ELSE 'collapsed' END AS status, CASE WHEN pos = k.first THEN '' ELSE 'identical_duplicate' END AS reason,
    k.first AS representative_row_position, dense AS projection_row_position FROM r JOIN k USING (l_suppkey, l_orderkey) JOIN d ON d.first = k.first""")
def row_audit(spark, sf_dir):
    rows = _orders(spark, sf_dir).drop("l_quantity", "row_position")
    a = assess(with_row_position(rows.orderBy(*rows.columns)), _config(_ORDERS, policies={"duplicates": "collapse_identical"}))
    return a.audit.drop("normalized_columns")


_DOCS = {"source": ["source"], "unit": ["unit"], "group": ["group"]}
_METRIC_SQL = {
    "design.n_records": "(SELECT count(*) FROM f)", "design.n_sources": "rk.s", "design.n_groups": "rk.g", "design.n_units": "(SELECT count(DISTINCT unit) FROM f)", "entropy.H_G": "hg", "entropy.H_G_given_D": "hc",
    "entropy.mutual_information": "hg - hc", "entropy.ratio": "hc / hg", "entropy.U_G_given_D": "1 - hc / hg", "ceiling.balanced_accuracy": "acc", "ceiling.q_star": "bst.q", "ceiling.sensitivity": "bst.sens",
    "ceiling.specificity": "bst.spec", "structure.n_spanning_sources": "(SELECT count(*) FROM ps WHERE k > 1)", "guards.cramers_v": "v", "guards.min_units_per_source": "mn", "guards.n_singleton_sources": "ones",
    "guards.design_rank": "rk.s + rk.g - rk.k", "guards.design_columns": "rk.s + rk.g - 1", "guards.rank_deficient": "(rk.k > 1)::INT",
}


@query("diagnose_metrics", Q._GUARD + " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, '{n.split('.')[0]}' AS family, round(({x})::DOUBLE, 9) + 0.0 AS value, 'ok' AS status FROM tot, vv, rk, bs, bst" for n, x in _METRIC_SQL.items()))
def diagnose_metrics(spark, sf_dir):
    result = diagnose(D.labels_design(spark, sf_dir).drop("weight"), config=_config(_DOCS), budget="off")
    return metric_table(result, spark).where(F.col("metric").isin(*_METRIC_SQL)).select("metric", "family", "value", "status")


@query("core_report")
def core_report(spark, sf_dir):
    return report.diagnose(Corpus.from_frame(D.labels_design(spark, sf_dir), weight="weight"), bootstrap=200).to_frame(spark)
