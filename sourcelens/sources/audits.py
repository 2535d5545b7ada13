"""Column audits: what a table's columns look like and whether a design can be recovered from it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.keys import KeySpec, as_spec, key, stripped

#: Texts that count as missing in audits (case-sensitive), and the form of accession numbers.
MISSING = ("", "nan", "None", "NaN", "<NA>")
ACCESSION = r"^([A-Za-z]{1,8}[-_]?\d{3,}(\.\d+)?|[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})+-\d{2,})$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Words in column names that hint at a role.
HINTS = {
    "source": ("source", "accession", "dataset", "study", "project", "batch", "lab", "instrument", "run", "experiment", "series", "site", "center", "centre", "platform"),
    "unit": ("unit", "sample", "donor", "patient", "subject", "specimen", "individual", "participant", "barcode", "cell"),
    "group": ("group", "condition", "disease", "tissue", "status", "phenotype", "label", "class", "diagnosis", "treatment", "type"),
    "weight": ("weight", "mass", "count", "abundance", "intensity", "reads", "size"),
}
_SCORE_FLOOR = 2.0


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def _present(c: str) -> Column:
    text = stripped(_col(c))
    return text.isNotNull() & ~text.isin(*MISSING)


def _numbers(c: str, least: int) -> Column:
    return F.regexp_extract_all(F.when(_present(c), _col(c).cast("string")).otherwise(""), F.lit(r"(\d[\d,]{%d,})" % (least - 1)), F.lit(1))


def numeric_audit(df: DataFrame, columns: Sequence[str] | None = None, min_digits: int = 3) -> DataFrame:
    """Per column, in one scan: rows, missing, plain numbers, texts with a number of min_digits, texts with several numbers of any length, largest numbers found, an example."""
    if min_digits < 1:
        raise ValueError("min_digits must be 1 at least")
    columns = list(columns or df.columns)

    def audit(c: str) -> Column:
        ok, text = _present(c), _col(c).cast("string")
        largest = F.array_max(F.transform(_numbers(c, min_digits), lambda x: F.expr("double(0)") + F.replace(x, F.lit(","), F.lit("")).cast("double")))
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_missing"),
            F.count_if(F.coalesce(text.rlike(NUMBER), F.lit(False))).alias("n_direct_numeric"), F.count_if(F.size(_numbers(c, min_digits)) > 0).alias("n_with_number"),
            F.count_if(F.size(_numbers(c, 1)) > 1).alias("n_multi_number"), F.min(largest).alias("extracted_min"), F.max(largest).alias("extracted_max"),
            F.min(F.when(ok, F.regexp_replace(F.substring(text, 1, 80), r"[^\x00-\x7f]", "?"))).alias("example"),
        )

    out = df.agg(F.array(*[audit(c) for c in columns]).alias("a")).select(F.inline("a"))
    present = F.col("n") - F.col("n_missing")
    return out.withColumns({
        "frac_direct_numeric": F.when(present > 0, F.col("n_direct_numeric") / present), "frac_multi_number": F.when(present > 0, F.col("n_multi_number") / present),
    })


def with_prose(audit: DataFrame, max_direct: float = 0.5, min_multi: float = 0.2) -> DataFrame:
    """numeric_audit with looks_like_prose: few plain numbers and many texts with several."""
    prose = (F.col("frac_direct_numeric") <= max_direct) & (F.col("frac_multi_number") >= min_multi)
    return audit.withColumn("looks_like_prose", F.coalesce(prose, F.lit(False)))


def looks_like_prose(df: DataFrame, column: str, **limits) -> bool:
    return with_prose(numeric_audit(df, [column]), **limits).first().looks_like_prose


def column_profile(df: DataFrame) -> DataFrame:
    """Per column, in one scan: type, missing, distinct, shares of distinct, numeric and accession-like values, median length, prose."""
    kinds = dict(df.dtypes)

    def profile(c: str) -> Column:
        ok, text = _present(c), stripped(_col(c))
        some = F.when(ok, text)
        return F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_missing"), F.count_distinct(some).alias("n_unique"), F.count(some).alias("n_present"),
            F.avg(F.when(ok, text.rlike(NUMBER).cast("double"))).alias("frac_numeric"), F.avg(F.when(ok, text.rlike(ACCESSION).cast("double"))).alias("frac_accession_like"),
            F.median(F.length(some)).alias("median_len"),
        )

    out = df.agg(F.array(*[profile(c) for c in df.columns]).alias("a")).select(F.inline("a"))
    out = out.withColumn("frac_unique", F.when(F.col("n_present") > 0, F.col("n_unique") / F.col("n_present"))).drop("n_present")
    prose = with_prose(numeric_audit(df)).select("column", "looks_like_prose")
    return out.join(prose, "column")


def unsafe_weight_name(column: str) -> bool:
    """Names of totals, replicates and numbers of whole datasets: never proposed as weights."""
    words = set(re.findall("[a-z0-9]+", column.lower()))
    replicate = words & {"replicate", "replicates", "rep", "technicalreplicate"}
    total = words & {"total", "overall", "aggregate", "aggregated"}
    scope = words & {"dataset", "study", "project", "deposit", "cohort", "atlas"}
    counted = words & {"count", "counts", "number", "num", "n", "runs", "samples"}
    return bool(replicate or total or (scope and counted))


def infer_columns(df: DataFrame, hints: Mapping[str, Sequence[str]] | None = None, top: int = 3) -> dict[str, list[str]]:
    """Candidate columns per role, best first. A proposal only: nothing applies it."""
    known = dict(HINTS)
    for role, words in (hints or {}).items():
        if role not in known:
            raise KeyError(f"no role {role!r}; there are {sorted(known)}")
        known[role] = tuple(words)
    rows = max(1, df.count())
    scores: dict[str, dict[str, float]] = {r: {} for r in known}
    for p in column_profile(df).collect():
        if p.n_unique <= 1:
            continue
        hit = {r: 3.0 * any(w in p.column.lower() for w in words) for r, words in known.items()}
        accession, numeric, unique = p.frac_accession_like or 0.0, p.frac_numeric or 0.0, p.frac_unique or 0.0
        length = 0.5 if (p.median_len or 0) <= 25 else -2.0 if p.median_len > 60 else 0.0
        few = 2 <= p.n_unique <= max(10, 0.05 * rows)
        prose = p.looks_like_prose
        scores["source"][p.column] = hit["source"] + 4 * accession + length + (p.n_unique < rows) - 2 * prose
        scores["group"][p.column] = hit["group"] + 3 * (p.n_unique <= 10) + length + 1.5 * few - 2 * accession - 4 * prose - 2 * (unique > 0.5)
        scores["unit"][p.column] = hit["unit"] + length + 2 * (p.n_unique >= max(3, 0.05 * rows)) - (unique >= 1) - 2 * prose
        if not unsafe_weight_name(p.column):
            scores["weight"][p.column] = hit["weight"] + 3 * numeric - 5 * prose - 3 * (accession > 0.5)
    out = {r: [c for c, v in sorted(s.items(), key=lambda x: (-x[1], x[0])) if v >= _SCORE_FLOOR][:top] for r, s in scores.items()}
    if out["source"] and len(out["unit"]) > 1 and out["source"][0] == out["unit"][0]:
        out["unit"] = out["unit"][1:] + out["unit"][:1]
    return out


def check_recoverability(df: DataFrame, *, source: KeySpec, unit: KeySpec, group: KeySpec, weight: str | None = None) -> DataFrame:
    """order, check, status (ok, warn, blocked, unknown), value, detail; the verdict first. Never raises for what the table holds."""
    specs = {r: as_spec(s, r) for r, s in (("source", source), ("unit", unit), ("group", group))}
    used = [c for s in specs.values() for c in s] + ([weight] if weight else [])
    absent = [c for c in dict.fromkeys(used) if c not in df.columns]
    rows: list[tuple[str, str, float | None, str]] = [("required_columns_present", "blocked" if absent else "ok", float(len(absent)), ", ".join(absent))]
    if not absent:
        rows += _design_checks(df, specs)
    others = [c for c in df.columns if c not in {x for s in specs.values() for x in s}]
    audit = with_prose(numeric_audit(df, others)).collect() if others else []
    numeric = [a.column for a in audit if (a.frac_direct_numeric or 0) >= 0.99 and not unsafe_weight_name(a.column)]
    prose = [a.column for a in audit if a.looks_like_prose]
    rows.append(("numeric_weight_candidates", "ok" if numeric else "warn", float(len(numeric)), ", ".join(numeric)))
    rows.append(("prose_columns", "warn" if prose else "ok", float(len(prose)), ", ".join(prose)))
    if weight is None:
        rows.append(("weight_column_usable", "unknown", None, "no weight column is named"))
    elif weight in df.columns:
        bad = df.where(~F.coalesce(_col(weight).cast("string").rlike(NUMBER) & (F.expr(f"try_cast(`{weight}` as double)") >= 0), F.lit(False))).count()
        rows.append(("weight_column_usable", "blocked" if bad else "ok", float(bad), weight))
    worst = "blocked" if any(s == "blocked" for _, s, _, _ in rows) else "warn" if any(s == "warn" for _, s, _, _ in rows) else "ok"
    rows.insert(0, ("corpus_constructible", worst, None, "the worst status of the checks below"))
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "order int, check string, status string, value double, detail string")


def _design_checks(df: DataFrame, specs: dict[str, tuple[str, ...]]) -> list[tuple[str, str, float | None, str]]:
    keyed = df.select(*[key(s).alias(r) for r, s in specs.items()]).persist()
    complete = keyed.where("source is not null and unit is not null and `group` is not null")
    n, miss = keyed.count(), keyed.agg(*[F.count_if(F.col(f"`{r}`").isNull()).alias(r) for r in specs]).first()
    c = complete.agg(*[F.count_distinct(f"`{r}`").alias(r) for r in specs]).first()
    per_unit = complete.groupBy("unit").agg(F.count_distinct("group").alias("g"), F.count_distinct("source").alias("s")).agg(F.count_if(F.col("g") > 1).alias("mixed"), F.count_if(F.col("s") == 1).alias("one")).first()
    repeats = complete.groupBy("source", "unit").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    spanning = complete.groupBy("source").agg(F.count_distinct("group").alias("g")).where("g > 1").count()
    out = [("rows", "ok" if n else "blocked", float(n), "")]
    out += [(f"{r}_missing_cells", "warn" if miss[r] else "ok", float(miss[r]), "") for r in specs]
    out += [(f"n_{r}s", "ok" if c[r] else "blocked", float(c[r]), "") for r in specs]
    out.append(("n_groups_at_least_2", "ok" if c["group"] >= 2 else "blocked", float(c["group"]), ""))
    out.append(("unit_group_unique", "blocked" if per_unit.mixed else "ok", float(per_unit.mixed), "units in more than one group"))
    out.append(("duplicate_source_unit_rows", "warn" if repeats else "ok", float(repeats), ""))
    out.append(("sources_spanning_groups", "ok" if spanning else "warn", float(spanning), ""))
    out.append(("units_with_one_source", "ok", float(per_unit.one or 0), ""))
    keyed.unpersist()
    return out
