import os

import pytest
import pyarrow as pa
from tests.oracle import SF_DIR

import corpus_pipeline
from sourcelens.llm import common, exact


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")  # spark.checkpoint.dir cannot change in a session
    return tmp_path


def test_a_run_deletes_its_own_tables_only(spark, folder):
    """A lazy result outlives a whole pipeline run in its session; nothing is left once both are released."""
    small = SF_DIR.replace("sf0.01", "sf0.001")
    options = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    lazy = exact.op3_exact(spark, small)
    run = corpus_pipeline.run(spark, small)
    assert run.count() > 0 and len([x for x in os.listdir(folder) if x.startswith("pipeline-")]) == 1
    assert lazy.count() == 200
    common.release(run)
    assert lazy.count() == 200
    common.release(lazy)
    assert [x for x in os.listdir(folder) if not x.endswith(".crc")] == []
    assert options == (spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))


def test_a_failed_run_leaves_nothing(spark, folder):
    @common.tracked
    def broken(df):
        common.written(df, "half")
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        broken(spark.range(3))
    assert [x for x in os.listdir(folder) if not x.endswith(".crc")] == []


def test_small_batches(spark):
    """A table's job hands small Arrow batches to Python, and the session's option stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 2000000) AS t")
    with common.Tables() as own:
        most = common.written(wide.mapInArrow(sizes, "n long"), "batches", own).agg({"n": "max"}).first()[0]
        own.release()
    assert most <= 12_000_000 and spark.conf.get(key) == before
