import warnings

import pytest
from pyspark.sql import functions as F
from tests.fixtures import worked

from sourcelens.functions import keys
from sourcelens.operators.corpus import Corpus, DuplicateObservationWarning


def make(spark, rows, schema="source string, unit string, `group` string, weight string", **kw):
    return Corpus.from_frame(spark.createDataFrame(rows, schema), **kw)


def test_worked_counts(spark):
    c = Corpus.from_frame(worked(spark))
    got = c.counts()
    assert (got["n_rows"], got["n_sources"], got["n_units"], got["n_groups"]) == (84, 43, 44, 2)
    assert c.describe()["n_spanning_sources"] == 3 and c.describe()["units_per_source_max"] == 30


def test_keys(spark):
    rows = [("\t a ",), ("　b\x1c",), (" NaN ",), ("none",), ("<NA>",), ("",), (None,), ("NA",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(keys.text_key(F.col("x"))).collect()]
    assert got == ["a", "b", None, None, None, None, None, "NA"]
    with pytest.raises(TypeError):
        keys.as_spec([], "source")
    with pytest.raises(ValueError):
        keys.as_spec(["a", "a"], "source")


def test_composite_keys_never_collide(spark):
    rows = [("a|b", "c", "u1", "g"), ("a", "b|c", "u2", "h"), ("a", None, "u3", "g")]
    c = Corpus.from_frame(spark.createDataFrame(rows, "x string, y string, unit string, `group` string"), source=["x", "y"])
    assert c.counts()["n_sources"] == 2 and c.counts()["n_rows"] == 2 and c.counts()["n_records"] == 3
    assert {r.exclusion_reason for r in c.lineage().collect()} == {None, "missing_required_key"}


def test_dense_positions(spark):
    got = keys.with_row_position(spark.range(0, 1000, 1, 7)).orderBy("row_position").collect()
    assert [r.row_position for r in got] == list(range(1000))
    rows = spark.range(20000).selectExpr("id % 97 as a", "hash(id) as b")
    ranked = keys.with_row_position(rows.orderBy("a", "b"))  # adaptive execution may merge partitions
    got = ranked.orderBy("row_position").collect()
    assert [r.row_position for r in got] == list(range(20000)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in rows.collect())


@pytest.mark.parametrize("weight", ["-1", "abc", "inf", None, "1d"])
def test_bad_weights(spark, weight):
    with pytest.raises(ValueError, match="weights"):
        make(spark, [("s", "u", "g", weight), ("s", "v", "h", "1")], weight="weight")


def test_order_of_checks(spark):
    with pytest.raises(ValueError, match="no rows"):
        make(spark, [(None, "u", "g", "1")])
    with pytest.raises(ValueError, match="more than one group"):
        make(spark, [("s", "u", "g", "1"), ("t", "u", "h", "1")])
    with pytest.raises(KeyError):
        make(spark, [("s", "u", "g", "1")], source="nope")
    with pytest.raises(ValueError, match="no source"):
        make(spark, [("s", "u", "g", "1"), (None, "v", "g", "1")], dropna=False)
    with pytest.raises(ValueError, match="sum"):
        make(spark, [("s", "u", "g", "0")], weight="weight")


def test_duplicate_policies(spark):
    rows = [("s", "u", "g", "1"), ("s", "u", "g", "1"), (" s", "u", "g", "1"), ("t", "v", "h", "1")]
    with pytest.warns(DuplicateObservationWarning):
        make(spark, rows)
    with pytest.raises(ValueError, match="repeated"):
        make(spark, rows, duplicates="raise")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert make(spark, rows, duplicates="keep").counts()["n_rows"] == 4
        dropped = make(spark, rows, duplicates="drop", weight="weight")
    assert dropped.counts()["n_rows"] == 2 and dropped.records.count() == 4
    assert [r.exclusion_reason for r in dropped.lineage().orderBy("row_position").collect()] == [None, "duplicate_key", "duplicate_key", None]
    report = dropped.duplicate_report().collect()
    assert len(report) == 1 and report[0].excess_rows == 2 and report[0].varying_columns == ["source"] and report[0].record_positions == [0, 1, 2]
    with pytest.raises(ValueError, match="unequal"):
        make(spark, [("s", "u", "g", "1"), ("s", "u", "g", "2"), ("t", "v", "h", "1")], duplicates="drop", weight="weight")
    with pytest.raises(ValueError):
        make(spark, rows, duplicates="other")


def test_hierarchy(spark):
    schema = "source string, unit string, `group` string, donor string"
    rows = [("s", "u1", "g", "d1"), ("t", "u1", "g", None), ("s", "u2", "g", "d1"), ("s", "u3", "h", "d2"), ("s", "u4", "h", None)]
    c = make(spark, rows, schema, hierarchy={"donor": "donor"})
    r = c.hierarchy_report().first()
    assert (r.n_units, r.n_parents, r.n_units_with_parent, r.n_units_missing_parent) == (4, 2, 3, 1)
    assert (r.n_records_missing_parent, r.n_partially_mapped_units, r.n_multi_unit_parents, r.max_units_per_parent) == (2, 1, 1, 2)
    up = c.at_unit("donor")
    assert up.counts()["n_units"] == 2 and up.counts()["n_rows"] == 2
    with pytest.raises(ValueError, match="parent"):
        make(spark, [("s", "u", "g", "d1"), ("t", "u", "g", "d2"), ("s", "v", "h", "d3")], schema, hierarchy={"donor": "donor"})
    with pytest.raises(KeyError):
        c.at_unit("lab")


def test_transformations(spark):
    c = Corpus.from_frame(worked(spark))
    assert c.crossed_subcorpus().counts()["n_sources"] == 3
    assert c.subset(sources=["SRC-HUB"], groups=["Normal"]).counts()["n_rows"] == 30
    assert c.regroup({"Cancer": "x"}).counts()["n_groups"] == 1
    assert c.with_source("laboratory").counts()["n_sources"] == 2
    with pytest.raises(ValueError):
        c.regroup({})
    with pytest.raises(ValueError):
        c.subset(units=["nobody"])
