import pytest
from tests.fixtures import WORKED, worked_rows

from sourcelens.operators import entropy
from sourcelens.streaming import tables


def test_stream_equals_batch(spark, tmp_path):
    schema = "source string, unit string, `group` string, weight double, laboratory string"
    rows = worked_rows()
    for i in range(0, 84, 30):
        spark.createDataFrame(rows[i : i + 30], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    obs = tables.observations(stream, source="source", unit="unit", group="group")
    q = tables.start_mass(obs, "mass_now", str(tmp_path / "cp"))
    edges = tables.edge_stream(obs).writeStream.format("memory").queryName("edges_now").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
        edges.processAllAvailable()
        assert entropy.label_entropy(spark.table("mass_now")).first().ratio == pytest.approx(WORKED["ratio"], abs=1e-12)
        assert spark.table("edges_now").count() == 84
    finally:
        q.stop()
        edges.stop()


def test_windows(spark, tmp_path):
    df = spark.sql("select 's' source, concat('u', id) unit, if(id % 2 = 0, 'A', 'B') `group`, timestamp_seconds(id * 60) event_time from range(20)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    w = tables.windowed_mass(tables.observations(stream, source="source", unit="unit", group="group"), "10 minutes", "1 minute")
    q = w.writeStream.outputMode("append").format("memory").queryName("win_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("win_now").agg({"weight": "sum"}).first()[0] == 10
    finally:
        q.stop()
