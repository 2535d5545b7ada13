import json
import os

import pytest
from pyspark.sql import functions as F
from tests.fixtures import WORKED, config, worked

from sourcelens.api import cli
from sourcelens.api.config import AnalysisConfig, ConfigurationError
from sourcelens.api.diagnostics import METRICS, diagnose, metric_table, working_bytes
from sourcelens.api.results import DiagnosticComputationError, Metric
from sourcelens.api.run_record import RecordedRun, RunRecord, RunRecordError, run_analysis, verify_run
from sourcelens.api.validation import MetadataValidationError, assess, issue_table, validate
from sourcelens.operators import report
from sourcelens.operators.corpus import Corpus


def cfg(**changes):
    return AnalysisConfig.from_dict(config(**changes))


def table(spark, rows, schema="source string, unit string, `group` string, mass string, note string"):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows] if schema.count(",") == 4 else rows, schema)


# configuration -----------------------------------------------------------


def test_config_round_trip(tmp_path):
    c = cfg(hierarchy={"donor": ["d"]}, weighting={"mode": "column", "column": "m", "description": "x"})
    (tmp_path / "c.json").write_text("﻿" + c.to_json(), encoding="utf-8")
    assert AnalysisConfig.from_json(tmp_path / "c.json") == c and c.to_dict()["diagnostics"]["include"][0] == "design"


@pytest.mark.parametrize("change,path", [
    ({"schema_version": "9"}, "schema_version"), ({"extra": 1}, "extra"), ({"name": " "}, "name"), ({"columns": {"source": ["a"], "unit": ["b"]}}, "columns.group"),
    ({"columns": {"source": [], "unit": ["b"], "group": ["c"]}}, "columns.source"), ({"columns": {"source": ["a", "a"], "unit": ["b"], "group": ["c"]}}, "columns.source[1]"),
    ({"weighting": {"mode": "incidence", "column": "m"}}, "weighting.column"), ({"weighting": {"mode": "column", "column": "m"}}, "weighting.description"),
    ({"weighting": {"mode": "incidence", "column": None}}, "weighting.column"), ({"weighting": None}, "weighting"), ({"diagnostics": {"seed": None}}, "diagnostics.seed"),
    ({"policies": {"duplicates": "drop"}}, "policies.duplicates"), ({"policies": {"missing_tokens": [" x"]}}, "policies.missing_tokens[0]"),
    ({"diagnostics": {"include": ["magic"]}}, "diagnostics.include[0]"), ({"diagnostics": {"bootstrap_replicates": True}}, "diagnostics.bootstrap_replicates"),
    ({"execution": {"max_working_memory_mb": 0}}, "execution.max_working_memory_mb"), ({"hierarchy": {" d": ["x"]}}, "hierarchy"), ({"grain": {"name": "x", "description": "y", "z": 1}}, "grain.z"),
])
def test_config_errors_name_the_field(change, path):
    with pytest.raises(ConfigurationError) as e:
        cfg(**change)
    assert e.value.path == path


def test_config_json_is_strict(tmp_path):
    p = tmp_path / "c.json"
    for text in ('{"name": "a", "name": "b"}', '{"name": NaN}', "{", "[1]"):
        p.write_text(text)
        with pytest.raises(ConfigurationError):
            AnalysisConfig.from_json(p)
    p.write_bytes(b"\xff\xfe{}")
    with pytest.raises(ConfigurationError):
        AnalysisConfig.from_json(p)


# validation ----------------------------------------------------------------


def codes(spark, rows, **changes):
    return {i.code: i for i in validate(table(spark, rows), config=cfg(**changes)).issues}


GOOD = [("s1", "u1", "A", "1"), ("s1", "u2", "B", "2"), ("s2", "u3", "A", "3")]
MASS = {"weighting": {"mode": "column", "column": "mass", "description": "a mass"}}


def test_valid_table(spark):
    r = validate(table(spark, GOOD), config=cfg(**MASS))
    assert r.valid and not r.issues and r.counts["n_retained"] == 3 and r.counts["total_weight"] == 6.0 and r.counts["n_sources"] == 2


def test_key_issues(spark):
    got = codes(spark, [(" s1", "u1", "A"), ("s1", "None", "A"), ("s1", "u3", "NA"), ("s1", None, "B"), ("s1", "u5", " ")])
    changed = codes(spark, [(" s1", "u1", "A"), ("s1", "u2", "B")])["key_normalized"]
    assert changed.severity == "info" and changed.row_positions == (0,) and changed.columns == ("source",)
    assert got["core_reserved_key"].row_positions == (1,) and got["missing_required_key"].row_positions == (3, 4)
    dropped = codes(spark, [*GOOD, (None, "u9", "A")], policies={"missing_required": "drop"})
    assert dropped["missing_required_key"].severity == "warning"
    named = codes(spark, [*GOOD, ("s1", "u8", "NA")], policies={"missing_tokens": ["NA"]})
    assert named["missing_required_key"].row_positions == (3,)
    assert "missing_required_key" not in codes(spark, [*GOOD, ("s1", "u8", "na")], policies={"missing_tokens": ["NA"]})


def test_group_and_weight_issues(spark):
    assert codes(spark, [*GOOD, ("s3", "u1", "B")])["conflicting_group"].row_positions == (0, 3)
    bad = codes(spark, [("s1", "u1", "A", "x"), ("s1", "u2", "B", "-1"), ("s2", "u3", "A", "inf"), ("s2", "u4", "A", None), ("s2", "u5", "A", "1")], **MASS)
    assert bad["invalid_weight"].row_positions == (0, 1, 2, 3)
    assert codes(spark, [(s, u, g, "0") for s, u, g, _ in GOOD], **MASS)["zero_total_weight"].severity == "error"
    got = codes(spark, [("s1", "u1", "A", "1"), ("s1", "u2", "B", "0")], **MASS)
    assert got["no_group_contrast"].severity == "warning" and got["zero_weight_rows"].row_positions == (1,)
    assert "nonfinite_total_weight" in codes(spark, [("s1", "u1", "A", "1e308"), ("s1", "u2", "B", "1e308")], **MASS)
    assert "no_retained_records" in codes(spark, [(None, "u", "A")], policies={"missing_required": "drop"})


def test_shape_issues(spark):
    assert [i.code for i in validate(table(spark, GOOD).limit(0), config=cfg()).issues] == ["empty_input"]
    assert [i.code for i in validate(table(spark, GOOD).drop("unit"), config=cfg()).issues] == ["missing_columns"]
    assert [i.code for i in validate(table(spark, GOOD).toDF("source", "unit", "group", "x", "x"), config=cfg()).issues] == ["duplicate_columns"]
    assert [i.code for i in validate(table(spark, GOOD).withColumnRenamed("note", " "), config=cfg()).issues] == ["invalid_columns"]
    floats = spark.createDataFrame([("s", 1.0, "A"), ("s", float("inf"), "B"), ("s", float("nan"), "B")], "source string, unit double, `group` string")
    got = {i.code: i.row_positions for i in validate(floats, config=cfg()).issues}
    assert got["invalid_key"] == (1,) and got["missing_required_key"] == (2,)


def test_duplicates_and_audit(spark):
    rows = [("s", "u", "A", "1", "x"), (" s", "u", "A", "1.0", "x"), ("s", "v", "B", "1", "y"), (None, "w", "B", "1", "z"), ("s", "x", "B", "1", "y")]
    assert codes(spark, rows[:3])["duplicate_observation"].row_positions == (0, 1)
    assert codes(spark, rows[:3], policies={"duplicates": "keep_records"})["duplicate_records_retained"].severity == "warning"
    a = assess(table(spark, rows), cfg(**MASS, policies={"duplicates": "collapse_identical", "missing_required": "drop"}))
    assert a.report.valid and a.report.counts["n_retained"] == 3 and a.report.counts["n_excluded"] == 2
    audit = a.audit.orderBy("row_position").collect()
    assert [r.status for r in audit] == ["retained", "collapsed", "retained", "excluded", "retained"]
    assert [r.representative_row_position for r in audit] == [0, 0, 2, None, 4] and [r.projection_row_position for r in audit] == [0, 0, 1, None, 2]
    assert audit[1].normalized_columns == ["source", "mass"]
    differ = codes(spark, [("s", "u", "A", "1", "x"), ("s", "u", "A", "1", "other"), ("s", "v", "B", "1", "y")], policies={"duplicates": "collapse_identical"})
    assert differ["nonidentical_duplicate"].row_positions == (0, 1)
    with pytest.raises(MetadataValidationError):
        diagnose(table(spark, rows), config=cfg())


def test_parents(spark):
    rows = [("s1", "u1", "A", "d1"), ("s2", "u1", "A", "d2"), ("s1", "u2", "B", None)]
    got = codes(spark, rows, hierarchy={"donor": ["mass"]})
    assert got["conflicting_parent"].row_positions == (0, 1) and got["missing_parent"].severity == "warning"
    assert codes(spark, rows[2:], hierarchy={"donor": ["mass"]}, policies={"missing_parent": "error"})["missing_parent"].severity == "error"
    assert issue_table(table(spark, rows), cfg(hierarchy={"donor": ["mass"]})).count() == 2


# diagnosis -----------------------------------------------------------------


def test_worked_diagnosis(spark):
    f = worked(spark)
    r = diagnose(f, config=cfg(diagnostics={"include": list(METRICS)[:-1], "bootstrap_replicates": 200, "seed": 1}))
    assert [m.metric for m in r.metrics] == [f"{a}.{n}" for a, ns in METRICS.items() for n in ns] and len(r.metrics) == 33
    assert r.value("entropy.ratio") == pytest.approx(WORKED["ratio"], abs=1e-12) and r.value("entropy.H_G") == pytest.approx(WORKED["h_group"], abs=1e-12)
    assert r.value("design.n_units") == 44 and r.value("structure.n_spanning_sources") == 3 and r.status("bootstrap.lower") == "ok"
    assert r.value("ceiling.balanced_accuracy") == pytest.approx(0.537433155080214, abs=1e-12)
    assert set(r.tables) == {
        "input.observations", "design.sources", "design.units", "entropy.per_source", "ceiling.contrast", "structure.spanning_sources", "structure.pair_sharing", "structure.source_removal",
        "structure.source_removal_by_group", "entropy_loso.sources", "bootstrap.replicates", "execution.stages",
    }
    assert r.tables["structure.source_removal_by_group"].count() == 43 * 2
    json.loads(r.to_json())
    assert metric_table(r, spark).count() == 33


def test_statuses(spark):
    r = diagnose(table(spark, [("s", "u", "A"), ("t", "v", "A")]), config=cfg())
    assert r.status("entropy.ratio") == "undefined" and r.status("ceiling.q_star") == "not_applicable" and r.status("guards.design_rank") == "not_applicable"
    assert r.status("guards.cramers_v") == "undefined" and r.status("bootstrap.upper") == "not_requested" and r.status("entropy_loso.n_sources") == "not_requested"
    three = diagnose(table(spark, [("S1", "u1", "A"), ("S1", "u2", "B"), ("S2", "u3", "C")]), config=cfg())
    assert (three.value("guards.design_rank"), three.value("guards.design_columns"), three.value("guards.rank_deficient")) == (3, 4, 1)
    with pytest.raises(ValueError):
        Metric("entropy.ratio", None, "ok", "", "")


def test_budget(spark):
    f = spark.range(600).selectExpr("concat('s', id) as source", "concat('u', id) as unit", "if(id % 2 = 0, 'A', 'B') as `group`")
    small = cfg(execution={"max_working_memory_mb": 1})
    r = diagnose(f, config=small)
    limited = {m.metric for m in r.metrics if m.status == "resource_limited"}
    assert limited == {"structure.pair_sharing.n_groups", "structure.source_removal.n_sources", "guards.design_rank", "guards.design_columns", "guards.rank_deficient"}
    assert r.value("entropy.ratio") == 0 and r.resource_limited and working_bytes(1, 1, 1, 1)["mass"] == 256
    assert not diagnose(f, config=small, budget="off").resource_limited


def test_stage_failure(spark, monkeypatch):
    from sourcelens.operators import entropy

    monkeypatch.setattr(entropy, "label_entropy", lambda w: 1 / 0)
    with pytest.raises(DiagnosticComputationError) as e:
        diagnose(table(spark, GOOD), config=cfg())
    assert e.value.stage == "entropy" and e.value.validation.valid
    run = run_analysis(spark, table(spark, GOOD), config=cfg())
    assert run.exit_code == 3 and run.report["scope"] == "diagnostic_error" and run.report["stage"] == "entropy"


# records and command line -----------------------------------------------


@pytest.fixture
def files(tmp_path):
    (tmp_path / "m.csv").write_text("source,unit,group\n" + "".join(f"{s},{u},{g}\n" for s, u, g, _ in GOOD), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps(config()))
    return tmp_path


def test_record_and_verification(spark, files):
    run = run_analysis(spark, files / "m.csv", config=files / "c.json")
    assert run.exit_code == 0
    record = RunRecord.from_dict(run.record.to_dict())
    ok = verify_run(record, metadata=files / "m.csv", config=files / "c.json", report=run.report)
    assert ok["verified"] and {c["status"] for c in ok["checks"]} == {"match"}
    (files / "m.csv").write_text("source,unit,group\nx,y,z\n")
    bad = verify_run(record, metadata=files / "m.csv", config=files / "gone.json")
    assert not bad["verified"] and {c["name"]: c["status"] for c in bad["checks"]}["metadata"] == "mismatch"
    wrong = run.report | {"scope": "metadata_validation"}
    with pytest.raises(RunRecordError):
        RecordedRun(wrong, record)
    for change in ({"exit_code": 2}, {"command": "other"}, {"environment": {}}, {"scope": "x"}):
        with pytest.raises(RunRecordError):
            RunRecord.from_dict(run.record.to_dict() | change)
    assert run_analysis(spark, table(spark, [("s", "u", "A"), ("s", "u", "B")]), config=cfg()).exit_code == 2


def test_cli(spark, files, capsys):
    m, c, out, rec = (str(files / n) for n in ("m.csv", "c.json", "out.json", "rec.json"))
    assert cli.main(["validate", m, "--config", c]) == 0 and json.loads(capsys.readouterr().out)["valid"]
    assert cli.main(["diagnose", m, "--config", c, "--output", out, "--run-record", rec]) == 0
    assert cli.main(["verify", rec, "--metadata", m, "--config", c, "--report", out]) == 0
    assert cli.main(["diagnose", m, "--config", c, "--output", out]) == 3  # there already
    assert cli.main(["diagnose", m, "--config", c, "--output", out, "--overwrite"]) == 0
    assert cli.main(["diagnose", m, "--config", c, "--output", m, "--overwrite"]) == 3
    assert cli.main(["validate", str(files / "none.csv"), "--config", c]) == 2
    os.symlink(out, files / "link.json")
    assert cli.main(["validate", m, "--config", c, "--output", str(files / "link.json"), "--overwrite"]) == 3
    (files / "m.csv").write_text("source,unit,group\ns,u\n")
    assert cli.main(["validate", m, "--config", c]) == 2
    assert not [p for p in os.listdir(files) if p.startswith(".")]


def test_report(spark):
    d = report.diagnose(Corpus.from_frame(worked(spark)), bootstrap=50)
    assert d.ceiling["exact"] == pytest.approx(0.537433155080214) and d.crossed["n_sources"] == 3 and "0.537" in d.verdict()
    frame = d.to_frame(spark)
    assert frame.where(F.col("quantity") == "entropy.ratio").first().value == pytest.approx(WORKED["ratio"])
    assert "| entropy.ratio |" in d.to_markdown() and json.loads(d.to_json())["name"] == "corpus"
    one = report.diagnose(Corpus.from_frame(spark.createDataFrame([("s", "u", "A")], "source string, unit string, `group` string")))
    assert "no contrast" in one.verdict() and "crossed" in one.notes
