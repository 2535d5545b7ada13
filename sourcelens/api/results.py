"""The result of a diagnosis: a metric table with a status for every value, named tables, strict JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from sourcelens.api.config import AnalysisConfig
from sourcelens.api.validation import ValidationReport

#: Statuses of a metric, and the columns of the metric table.
STATUSES = ("ok", "undefined", "not_applicable", "not_requested", "resource_limited")
COLUMNS = ("metric", "family", "value", "status", "reason", "weighting")


class DiagnosticComputationError(RuntimeError):
    """A stage failed for a valid table."""

    def __init__(self, stage: str, message: str, validation: ValidationReport | None = None):
        self.stage, self.validation = stage, validation
        super().__init__(f"{stage}: {message}")


@dataclass(frozen=True)
class Metric:
    metric: str
    value: float | int | None
    status: str
    reason: str
    weighting: str

    def __post_init__(self) -> None:
        if self.status not in STATUSES:
            raise ValueError(f"no status {self.status!r}")
        if (self.status == "ok") != (self.value is not None and math.isfinite(self.value)):
            raise ValueError(f"{self.metric}: a finite value goes with status ok and with no other")

    @property
    def family(self) -> str:
        return self.metric.split(".")[0]

    def to_dict(self) -> dict[str, Any]:
        return {c: getattr(self, c) for c in COLUMNS}


def plain(value: Any) -> Any:
    """A Spark value for strict JSON: rows of composite keys become lists, values that are not finite null."""
    if isinstance(value, Row):
        return [plain(v) for v in value]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


@dataclass(frozen=True)
class DiagnosticResult:
    """Metrics, tables (DataFrames) and the audit of a valid table."""

    config: AnalysisConfig
    validation: ValidationReport
    metrics: tuple[Metric, ...]
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def value(self, name: str) -> float | int | None:
        return next(m.value for m in self.metrics if m.metric == name)

    def status(self, name: str) -> str:
        return next(m.status for m in self.metrics if m.metric == name)

    @property
    def resource_limited(self) -> bool:
        return any(m.status == "resource_limited" for m in self.metrics)

    def table_dict(self, name: str, limit: int | None = None) -> dict[str, Any]:
        """Columns and rows of a table, ordered by all its columns."""
        df = self.tables[name]
        rows = df.orderBy(*df.columns) if "order" not in df.columns else df.orderBy("order")
        got = (rows if limit is None else rows.limit(limit)).collect()
        return {"columns": df.columns, "data": [[plain(v) for v in r] for r in got]}

    def to_dict(self, limit: int | None = None) -> dict[str, Any]:
        return {
            "schema_version": self.config.schema_version, "scope": "metadata_diagnostics", "config": self.config.to_dict(), "validation": self.validation.to_dict(),
            "metrics": [m.to_dict() for m in self.metrics], "tables": {n: self.table_dict(n, limit) for n in sorted(self.tables)},
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, allow_nan=False, indent=2) + "\n"

    def save(self, path: str) -> None:
        """Every table as Parquet below path."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
