"""Diagnosis of a corpus: required and optional stages, one long table of quantities, Markdown and a verdict."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sourcelens.operators import ceiling as ceilings
from sourcelens.operators import entropy, guards, structure, tables
from sourcelens.operators.corpus import Corpus

#: Bounds of the verdict's bands for the ceiling, the ratio, and the ratio inside crossed sources.
CEILING_BANDS = (0.55, 0.70)
RATIO_BANDS = (0.20, 0.60)
CROSSED_FAVOURABLE = 0.50
INCIDENCE = "incidence (row weights not used)"


@dataclass
class Diagnosis:
    """What was computed, by stage; a stage that failed or does not apply is a note."""

    name: str
    weighting: str
    grain: str
    design: dict[str, Any]
    entropy: dict[str, Any]
    crossed: dict[str, Any] | None = None
    pair_sharing: list[dict[str, Any]] | None = None
    removal: dict[str, Any] | None = None
    ceiling: dict[str, Any] | None = None
    guards: list[dict[str, Any]] | None = None
    bootstrap: dict[str, Any] | None = None
    notes: dict[str, str] = field(default_factory=dict)

    def rows(self) -> list[tuple[str, float | None, str, str, str]]:
        """(quantity, value, weighting, grain, note) of everything."""
        out = []

        def add(prefix: str, values: dict[str, Any] | None, weighting: str) -> None:
            for k, v in (values or {}).items():
                if isinstance(v, bool) or isinstance(v, (int, float)) or v is None:
                    out.append((f"{prefix}.{k}", None if v is None else float(v), INCIDENCE if weighting is None else weighting, self.grain, self.notes.get(prefix, "")))

        add("design", self.design, None)
        add("entropy", self.entropy, self.weighting)
        add("crossed", self.crossed, self.weighting)
        for r in self.pair_sharing or []:
            add(f"pair_sharing[{r['group']}]", {k: v for k, v in r.items() if k != "group"}, None)
        add("structural_loso", self.removal, None)
        add("ceiling", self.ceiling, self.weighting)
        for r in self.guards or []:
            add("guard", {r["name"]: r["value"]}, self.weighting)
        add("bootstrap", self.bootstrap, self.weighting)
        return out

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "quantity string, value double, weighting string, grain string, note string")

    def verdict(self) -> str:
        """One paragraph: the band of the ceiling if there is one, else of the ratio, then the crossed sources and fired guards."""
        said = []
        exact, r = (self.ceiling or {}).get("exact"), self.entropy.get("ratio")
        if exact is not None:
            low, mid = CEILING_BANDS
            if exact <= 0.5 + 1e-12:
                said.append("no predictor that is blind to more than the source's mix can beat chance: the contrast cannot be told from the sources")
            elif exact <= low:
                said.append(f"the ceiling is {exact:.3f}, barely above chance")
            elif exact <= mid:
                said.append(f"the ceiling is {exact:.3f}: little of the contrast is free of the sources")
            else:
                said.append(f"the ceiling is {exact:.3f}: the contrast is largely free of the sources")
        elif r is None:
            said.append("all mass is in one group, so there is no contrast")
        else:
            low, mid = RATIO_BANDS
            how = "hardly any" if r <= low else "part" if r <= mid else "most"
            said.append(f"the residual ratio is {r:.3f}: {how} of the label's entropy is left within sources")
        inner = (self.crossed or {}).get("ratio")
        if inner is not None:
            said.append(f"inside sources with several groups it is {inner:.3f}, {'favourable' if inner >= CROSSED_FAVOURABLE else 'not favourable'}")
        fired = [g["name"] for g in self.guards or [] if g["fires"]]
        if fired:
            said.append(f"guards that fire: {', '.join(fired)}")
        return f"{self.name} ({self.grain}; {self.weighting}): " + "; ".join(said) + "."

    def to_markdown(self) -> str:
        lines = [f"# {self.name}", "", self.verdict(), "", "| quantity | value | weighting | note |", "| --- | --- | --- | --- |"]
        for q, v, w, _, note in self.rows():
            shown = "undefined" if v is None or math.isnan(v) else f"{v:.6g}"
            lines.append(f"| {q} | {shown} | {w} | {note} |")
        if self.notes:
            lines += ["", "## Notes", "", *[f"- {k}: {v}" for k, v in sorted(self.notes.items())]]
        return "\n".join(lines) + "\n"

    def as_dict(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items()} | {"verdict": self.verdict()}

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), allow_nan=False, default=str, indent=2) + "\n"


def diagnose(corpus: Corpus, *, grain: str = "the corpus's source column", bootstrap: int = 0, seed: int = 0, positive: str | None = None, strict: bool = False) -> Diagnosis:
    """Entropy and the design are required; other stages that fail leave a note (strict: raise)."""
    frame = corpus.frame.persist()
    w = tables.source_group_weight(frame).persist()
    e = entropy.label_entropy(w).first().asDict()
    top = entropy.per_source(w).agg({"contribution": "max"}).first()[0]
    out = Diagnosis(corpus.name, corpus.weighting, grain, tables.describe(frame).first().asDict(), e | {"max_source_contribution": top})

    def stage(name: str, f: Callable[[], Any]) -> Any:
        try:
            return f()
        except Exception as error:  # recorded as the stage's note
            if strict:
                raise
            out.notes[name] = str(error) or type(error).__name__
            return None

    def crossed():
        inner = corpus.crossed_subcorpus()
        return entropy.label_entropy(inner.w).first().asDict() | tables.counts(inner.frame).first().asDict()

    def removal():
        table = structure.source_removal(frame)
        worst = structure.worst_removals(frame).agg({"worst_removal_fraction": "max"}).first()[0]
        return {"max_units_covered": table.agg({"units_covered": "max"}).first()[0], "max_emptied": table.agg({"emptied_total": "max"}).first()[0], "max_fraction_emptied": worst}

    def boot():
        r = entropy.bootstrap_ratio(w, bootstrap, seed)
        return {k: getattr(r, k) for k in ("observed", "lower", "upper", "n_effective", "n_degenerate", "frac_exactly_zero")}

    if out.design["n_spanning_sources"]:
        out.crossed = stage("crossed", crossed)
    else:
        out.notes["crossed"] = "no source is in several groups"
    out.pair_sharing = stage("pair_sharing", lambda: [r.asDict() for r in structure.pair_sharing_by_group(frame).orderBy("group").collect()])
    out.removal = stage("structural_loso", removal)
    if out.design["n_groups"] == 2:
        out.ceiling = stage("ceiling", lambda: ceilings.balanced_accuracy_ceiling(w, positive).first().asDict())
    else:
        out.notes["ceiling"] = "a ceiling needs two groups"
    known = (out.ceiling or {}).get("exact")
    out.guards = stage("guards", lambda: [r.asDict() for r in guards.guard_report(frame, known).collect()])
    if bootstrap:
        out.bootstrap = stage("bootstrap", boot)
    return out
