"""Metadata validation: issues with row positions, counts, the prepared projection and the audit of every row.

Rules become boolean columns of one projection; an issue is an aggregate over
the rows that a rule marks. Nothing is looped row by row.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.api.config import AnalysisConfig
from sourcelens.functions.keys import stripped, with_row_position

POSITION = "row_position"
ROLES = ("source", "unit", "group")
#: Key texts that an analysis cannot tell from missing ones.
RESERVED = ("none", "nan", "<na>")
#: Row positions that an issue lists; its number of rows is always exact.
LISTED = 100_000
COUNTS = ("n_records", "n_error_records", "n_key_complete", "n_retained", "n_excluded", "n_duplicate_keys", "n_duplicate_rows", "n_sources", "n_units", "n_groups", "total_weight")

_MESSAGES = {
    "duplicate_columns": "column names repeat", "invalid_columns": "column names must not be blank", "missing_columns": "configured columns are not in the table", "empty_input": "the table has no rows",
    "invalid_key": "keys must be finite scalars", "core_reserved_key": "a key reads like a missing value; rename it or declare it missing", "missing_required_key": "rows lack a source, unit or group",
    "key_normalized": "keys were compared as texts without white space around them", "conflicting_group": "a unit is in several groups", "missing_parent": "rows lack a parent",
    "conflicting_parent": "a unit has several parents at one level", "invalid_weight": "weights must be finite numbers that are not negative", "duplicate_observation": "keys repeat and no policy allows it",
    "duplicate_records_retained": "repeated keys are kept, each with its weight", "identical_duplicates_collapsed": "identical records were collapsed to the first", "nonidentical_duplicate": "records of a key differ and cannot be collapsed",
    "no_retained_records": "no row is left", "nonfinite_total_weight": "the weights sum to no finite number", "zero_total_weight": "all weights are zero", "no_group_contrast": "only one group has mass",
    "zero_weight_rows": "rows of zero weight count as records but carry no mass", "mixed_key_shapes": "a key mixes scalars and tuples",
}


@dataclass(frozen=True)
class ValidationIssue:
    code: str
    severity: str
    message: str
    row_positions: tuple[int, ...] = ()
    columns: tuple[str, ...] = ()
    n_rows: int = 0

    def __post_init__(self) -> None:
        if self.severity not in ("error", "warning", "info"):
            raise ValueError(f"no severity {self.severity!r}")

    def to_dict(self) -> dict[str, Any]:
        return {"code": self.code, "severity": self.severity, "message": self.message, "row_positions": list(self.row_positions), "columns": list(self.columns)}


@dataclass(frozen=True)
class ValidationReport:
    config: AnalysisConfig
    issues: tuple[ValidationIssue, ...]
    counts: Mapping[str, int | float | None]

    @property
    def valid(self) -> bool:
        return all(i.severity != "error" for i in self.issues)

    def to_dict(self) -> dict[str, Any]:
        return {
            "schema_version": self.config.schema_version, "scope": "metadata_validation", "valid": self.valid, "config": self.config.to_dict(), "counts": dict(self.counts),
            "issues": [i.to_dict() for i in self.issues],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, allow_nan=False, indent=2)

    def raise_for_errors(self) -> None:
        if not self.valid:
            raise MetadataValidationError(self)


class MetadataValidationError(ValueError):
    """The table does not fit the configuration."""

    def __init__(self, report: ValidationReport):
        self.report = report
        super().__init__("; ".join(f"{i.code}: {i.message}" for i in report.issues if i.severity == "error"))


@dataclass(frozen=True)
class Assessment:
    """A report with the prepared rows; projection and audit are None unless the table is valid."""

    report: ValidationReport
    projection: DataFrame | None = None
    audit: DataFrame | None = None


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


class _Issues:
    """Collects issues. The rows that plain rules mark are counted in one aggregate; positions are fetched for rules that mark any."""

    def __init__(self, rows: DataFrame, flags: list[str]):
        self.rows, self.found, self.error_flags = rows, [], []
        counted = rows.agg(F.count(F.lit(1)), *[F.count_if(F.coalesce(F.col(f), F.lit(False))) for f in flags]).first()
        self.n_records, self.counts = counted[0], dict(zip(flags, counted[1:]))

    def add(self, code: str, severity: str, columns=(), flag: str | None = None, rows: DataFrame | None = None) -> bool:
        positions, n = (), 0
        if flag is not None:
            if rows is None and not self.counts[flag]:
                return False
            marked = (self.rows if rows is None else rows).where(F.col(flag))
            n = marked.count() if rows is not None else self.counts[flag]
            if not n:
                return False
            positions = tuple(r[0] for r in marked.select(POSITION).orderBy(POSITION).limit(LISTED).collect())
            if severity == "error":
                self.error_flags.append(marked.select(POSITION))
        self.found.append(ValidationIssue(code, severity, _MESSAGES[code], positions, tuple(dict.fromkeys(columns)), n))
        return True

    def n_error_rows(self) -> int:
        return reduce(DataFrame.union, self.error_flags).distinct().count() if self.error_flags else 0


def assess(df: DataFrame, config: AnalysisConfig) -> Assessment:
    """Validates and prepares a table in one pass over a projection that is kept for the rules."""
    if not isinstance(df, DataFrame) or not isinstance(config, AnalysisConfig):
        raise TypeError("a Spark DataFrame and an AnalysisConfig are needed")
    counts: dict[str, Any] = dict.fromkeys(COUNTS)
    counts["n_error_records"] = 0
    given = [c for c in df.columns if c != POSITION]

    def stop(code: str, columns=()) -> Assessment:
        return Assessment(ValidationReport(config, (ValidationIssue(code, "error", _MESSAGES[code], (), tuple(columns)),), counts))

    if repeated := [c for i, c in enumerate(given) if c in given[:i]]:
        return stop("duplicate_columns", repeated)
    if any(not c.strip() for c in given):
        return stop("invalid_columns")
    roles = {r: getattr(config.columns, r) for r in ROLES}
    levels = dict(config.hierarchy)
    key_columns = list(dict.fromkeys(c for cols in (*roles.values(), *levels.values()) for c in cols))
    weight_column = config.weighting.column if config.weighting.mode == "column" else None
    if absent := [c for c in dict.fromkeys([*key_columns, *([weight_column] if weight_column else [])]) if c not in given]:
        counts["n_records"] = df.count()
        return stop("missing_columns", absent)

    rows = df if POSITION in df.columns else with_row_position(df, POSITION)
    rows = _normalized(rows, df, config, key_columns, roles, levels, weight_column, given).persist()
    flags = [f"k{i}_{e}" for i in range(len(key_columns)) for e in ("invalid", "reserved", "changed")]
    issues = _Issues(rows, [*flags, "missing_key", "bad_weight", "eligible"])
    counts["n_records"] = issues.n_records
    if not counts["n_records"]:
        counts.update({k: 0 for k in COUNTS}, total_weight=0.0)
        return stop("empty_input")
    _key_rules(issues, config, key_columns, roles, levels)
    if weight_column:
        issues.add("invalid_weight", "error", [weight_column], "bad_weight")
    rows, excluded = _duplicates(issues, rows, config, roles, counts)
    retained = rows.where("eligible").where(~excluded)
    _totals(issues, rows, retained, counts, config, roles)
    counts["n_error_records"] = issues.n_error_rows()
    report = ValidationReport(config, tuple(issues.found), counts)
    if not report.valid:
        return Assessment(report)
    return Assessment(report, _projection(retained, levels), _audit(rows, excluded, given))


def _normalized(rows, df, config, key_columns, roles, levels, weight_column, given) -> DataFrame:
    """Texts, flags and keys of every row; raw columns stay for the comparison of records."""
    kinds = dict(df.dtypes)
    tokens = list(config.policies.missing_tokens)
    cols: dict[str, Column] = {}
    for i, c in enumerate(key_columns):
        raw, text = _col(c), stripped(_col(c))
        odd = (F.isnan(raw) | (F.abs(raw) == float("inf"))) if kinds[c] in ("double", "float") else F.lit(False)
        gone = raw.isNull() | (F.isnan(raw) if kinds[c] in ("double", "float") else F.lit(False)) | (text == "") | text.isin(tokens)
        invalid = F.coalesce(odd & ~F.isnan(raw), F.lit(False)) if kinds[c] in ("double", "float") else F.lit(False)
        reserved = ~gone & F.lower(text).isin(*RESERVED)
        cols[f"k{i}"] = F.when(~(gone | invalid | reserved), text)
        cols[f"k{i}_invalid"], cols[f"k{i}_reserved"] = invalid, F.coalesce(reserved, F.lit(False))
        changed = raw.isNotNull() if kinds[c] != "string" else F.coalesce(text != raw, F.lit(False)) | F.coalesce(text.isin(tokens), F.lit(False))
        cols[f"k{i}_changed"] = changed
    out = rows.withColumns(cols)
    at = {c: f"k{i}" for i, c in enumerate(key_columns)}

    def key(names: tuple[str, ...]) -> Column:
        parts = [F.col(at[c]) for c in names]
        if len(parts) == 1:
            return parts[0]
        return F.when(~_any([p.isNull() for p in parts]), F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]))

    out = out.withColumns({f"role_{r}": key(n) for r, n in roles.items()} | {f"parent_{i}": key(n) for i, n in enumerate(levels.values())})
    out = out.withColumn("eligible", F.col("role_source").isNotNull() & F.col("role_unit").isNotNull() & F.col("role_group").isNotNull())
    out = out.withColumn("key_error", _any([F.col(f"{at[c]}_{e}") for n in roles.values() for c in n for e in ("invalid", "reserved")]))
    out = out.withColumn("missing_key", ~F.col("eligible") & ~F.col("key_error"))
    if weight_column:
        kind = kinds[weight_column]
        text = F.trim(_col(weight_column).cast("string"))
        plain = text.rlike(r"^[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        w = F.when(plain, F.expr(f"try_cast(trim(cast(`{weight_column}` as string)) as double)")) if kind in ("string", *_numeric_kinds(kind)) else F.lit(None).cast("double")
        out = out.withColumn("weight", F.when((w >= 0) & (w < float("inf")), w)).withColumn("bad_weight", F.col("eligible") & F.col("weight").isNull())
        out = out.withColumn("weight_changed", F.col("weight").isNotNull() & F.lit(kind != "double"))
    else:
        out = out.withColumns({"weight": F.lit(1.0), "bad_weight": F.lit(False), "weight_changed": F.lit(False)})
    changes = [F.when(F.col(f"{at[c]}_changed"), F.lit(c)) for c in given if c in at]
    if weight_column:
        changes.append(F.when(F.col("weight_changed"), F.lit(weight_column)))
    # whole records in normalized form, for the comparison of repeated keys
    cell = lambda c: F.col("weight") if c == weight_column else F.col(at[c]) if c in at else _col(c)
    record = F.to_json(F.struct(*[cell(c).alias(f"f{i}") for i, c in enumerate(given)])) if given else F.lit("")
    return out.withColumns({"normalized_columns": F.array_distinct(F.array_compact(F.array(*changes))), "record": record})


def _numeric_kinds(kind: str) -> tuple[str, ...]:
    return (kind,) if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else ()


def _key_rules(issues: _Issues, config: AnalysisConfig, key_columns, roles, levels) -> None:
    for i, c in enumerate(key_columns):
        issues.add("invalid_key", "error", [c], f"k{i}_invalid")
        issues.add("core_reserved_key", "error", [c], f"k{i}_reserved")
    role_columns = [c for n in roles.values() for c in n]
    issues.add("missing_required_key", "warning" if config.policies.missing_required == "drop" else "error", role_columns, "missing_key")
    for i, c in enumerate(key_columns):
        issues.add("key_normalized", "info", [c], f"k{i}_changed")
    live = issues.rows.where("eligible")
    groups = live.groupBy("role_unit").agg(F.count_distinct("role_group").alias("n")).where("n > 1").select("role_unit", F.lit(True).alias("hit"))
    issues.add("conflicting_group", "error", (*roles["unit"], *roles["group"]), "hit", live.join(groups, "role_unit"))
    for i, (level, cols) in enumerate(levels.items()):
        none = live.withColumn("hit", F.col(f"parent_{i}").isNull())
        issues.add("missing_parent", "error" if config.policies.missing_parent == "error" else "warning", cols, "hit", none)
        several = live.groupBy("role_unit").agg(F.count_distinct(f"parent_{i}").alias("n")).where("n > 1").select("role_unit", F.lit(True).alias("hit"))
        issues.add("conflicting_parent", "error", (*roles["unit"], *cols), "hit", live.join(several, "role_unit"))


def _duplicates(issues: _Issues, rows: DataFrame, config: AnalysisConfig, roles, counts) -> tuple[DataFrame, Column]:
    """Marks repeats and applies the policy; returns the rows and which of them are excluded."""
    keys = [f"role_{r}" for r in ROLES]
    per = rows.where("eligible").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_of_key"), F.min(POSITION).alias("first_of_key"), F.count_distinct("record").alias("n_forms"), F.count_if("bad_weight").alias("n_bad"))
    per = per.where("n_of_key > 1")
    counts["n_duplicate_keys"], extra = per.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_of_key") - 1), F.lit(0))).first()
    counts["n_duplicate_rows"] = extra
    rows = rows.join(per, keys, "left") if extra else rows.withColumns({c: F.lit(None).cast("long") for c in ("n_of_key", "first_of_key", "n_forms", "n_bad")})
    repeated = F.col("n_of_key").isNotNull() & F.col("eligible")
    same = repeated & (F.col("n_forms") == 1) & (F.col("n_bad") == 0)
    collapse = config.policies.duplicates == "collapse_identical"
    collapsed = F.coalesce(same & (F.col(POSITION) != F.col("first_of_key")), F.lit(False)) if collapse else F.lit(False)
    rows = rows.withColumns({"repeated": F.coalesce(repeated, F.lit(False)), "collapsed": collapsed, "differing": F.coalesce(repeated & ~same, F.lit(False))})
    columns = [c for n in roles.values() for c in n]
    if extra:
        if config.policies.duplicates == "error":
            issues.add("duplicate_observation", "error", columns, "repeated", rows)
        elif not collapse:
            issues.add("duplicate_records_retained", "warning", columns, "repeated", rows)
        else:
            issues.add("identical_duplicates_collapsed", "warning", columns, "collapsed", rows)
            issues.add("nonidentical_duplicate", "error", columns, "differing", rows)
    return rows, F.col("collapsed")


def _totals(issues: _Issues, rows: DataFrame, retained: DataFrame, counts, config: AnalysisConfig, roles) -> None:
    dropped = issues.counts["missing_key"] if config.policies.missing_required == "drop" else 0
    counts["n_key_complete"] = issues.counts["eligible"]
    row = retained.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(f"role_{r}").alias(r) for r in ROLES], F.count_if(F.col("weight").isNull()).alias("bad"), F.sum("weight").alias("total"),
        F.count_distinct(F.when(F.col("weight") > 0, F.col("role_group"))).alias("live"),
    ).first()
    counts.update(n_retained=row.n, n_excluded=dropped + issues.counts["eligible"] - row.n, n_sources=row.source, n_units=row.unit, n_groups=row.group)
    everything = retained.withColumn("hit", F.lit(True))
    if not row.n:
        counts["total_weight"] = 0.0
        issues.add("no_retained_records", "error")
    elif not row.bad:
        if row.total == float("inf"):
            issues.add("nonfinite_total_weight", "error", [config.weighting.column] if config.weighting.column else [], "hit", everything)
        else:
            counts["total_weight"] = float(row.total)
            if row.total == 0:
                issues.add("zero_total_weight", "error", (), "hit", everything)
            elif row.live < 2:
                issues.add("no_group_contrast", "warning", roles["group"], "hit", everything)
        issues.add("zero_weight_rows", "warning", (), "hit", retained.withColumn("hit", F.col("weight") == 0))


def _projection(retained: DataFrame, levels) -> DataFrame:
    return retained.select(POSITION, *[F.col(f"role_{r}").alias(r) for r in ROLES], "weight", *[F.col(f"parent_{i}").alias(f"h_{level}") for i, level in enumerate(levels)])


def _audit(rows: DataFrame, excluded: Column, given) -> DataFrame:
    """row_position, status, reason, representative_row_position, projection_row_position, normalized_columns of every input row."""
    kept = F.col("eligible") & ~excluded
    dense = with_row_position(rows.where(kept).select(POSITION).orderBy(POSITION), "projection_row_position")
    status = F.when(F.col("collapsed"), "collapsed").when(kept, "retained").otherwise("excluded")
    reason = F.when(F.col("collapsed"), "identical_duplicate").when(kept, "").otherwise("missing_required_key")
    stands = F.when(F.col("collapsed"), F.col("first_of_key")).when(kept, F.col(POSITION))
    out = rows.select(POSITION, status.alias("status"), reason.alias("reason"), stands.alias("representative_row_position"), "normalized_columns")
    return out.join(dense.withColumnRenamed(POSITION, "representative_row_position"), "representative_row_position", "left").select(
        POSITION, "status", "reason", "representative_row_position", "projection_row_position", "normalized_columns"
    )


def validate(df: DataFrame, *, config: AnalysisConfig) -> ValidationReport:
    """The report of a table under a configuration; it never raises for what the table holds."""
    return assess(df, config).report


def issue_table(df: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The issues as rows: code, severity, message, row_positions, columns, n_rows."""
    rows = [(i.code, i.severity, i.message, list(i.row_positions), list(i.columns), i.n_rows) for i in validate(df, config=config).issues]
    return df.sparkSession.createDataFrame(rows, "code string, severity string, message string, row_positions array<long>, columns array<string>, n_rows long")
