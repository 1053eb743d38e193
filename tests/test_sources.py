"""Sources and sinks of their own: payload files under a commit protocol, the replay of ticks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tideframe.sources import payload
from tideframe.sources.adapters import table
from tideframe.sources.payload_files import PayloadFiles, _Writer
from tideframe.streaming.replay import SCHEMA, TickReplay

SF = "/root/testdata/sf0.001"


def test_pages_are_bounded_and_come_back(spark, tmp_path):
    rows = spark.range(1234).select(F.when(F.col("id") < 1000, "a/b").otherwise("c").alias("key"), (F.col("id") * 60).alias("es"), F.col("id").cast("double").alias("value"))
    made = payload.export(rows, "key", "points", page_rows=100)
    assert {(r["name"], r["page"]): len(json.loads(r["body"])) for r in made.collect()} == {("a/b", p): 100 for p in range(10)} | {("c", 0): 100, ("c", 1): 100, ("c", 2): 34}
    payload.write_payload_files(made, f"file://{tmp_path}/out")
    back, rejects = payload.ingest(payload.read_payload_files(spark, f"file://{tmp_path}/out"), "points")
    assert rejects.count() == 0 and sorted(tuple(r) for r in back.collect()) == sorted((r["key"], r["es"], r["value"]) for r in rows.collect())
    payload.write_payload_files(made.where("page = 0"), f"file://{tmp_path}/out")  # a second job adds to the first
    assert payload.read_payload_files(spark, f"file://{tmp_path}/out").count() == 15


def test_a_failed_job_leaves_nothing_to_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good = spark.createDataFrame([("a", 0, "[]")], "name string, page int, body string")
    payload.write_payload_files(good, path)
    bad = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("name"), F.lit(0).alias("page"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("[]")).alias("body"))
    with pytest.raises(Exception, match="lost"):
        payload.write_payload_files(bad, path)
    assert [r["name"] for r in payload.read_payload_files(spark, path).collect()] == ["a"]
    assert len(os.listdir(f"{tmp_path}/out/manifests")) == 1


def test_files_without_a_commit_are_not_read(tmp_path):
    """A task that ran twice, and a driver lost before the commit."""
    writer = _Writer(str(tmp_path), overwrite=False)
    rows = [{"name": "a", "page": 0, "body": "one"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    reader = PayloadFiles({"path": str(tmp_path)}).reader(None)
    assert reader.partitions()[0].files == []
    writer.commit([kept, None])
    parts = reader.partitions()
    assert [tuple(x) for x in reader.read(parts[0])] == [("a", 0, "one")] and lost.files != kept.files
    again = _Writer(str(tmp_path), overwrite=True)
    again.commit([again.write(iter([{"name": None, "page": 1, "body": None}]))])
    assert [tuple(x) for x in reader.read(reader.partitions()[0])] == [(None, 1, "")]
    failed = _Writer(str(tmp_path), overwrite=False)
    failed.write(iter(rows))
    failed.abort([])
    assert failed.job not in os.listdir(tmp_path / "data")


def test_stream_keeps_rejects_apart(spark, tmp_path):
    bodies = [("ok", '[{"t": 60, "v": 1.5}]'), ("null", "null"), ("junk", "{"), ("undated", '[{"v": 2.0}]')]
    for i, row in enumerate(bodies):
        spark.createDataFrame([row], "name string, body string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("name string, body string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second start finds nothing new
        payload.ingest_stream(stream, "points", f"{tmp_path}/records", f"{tmp_path}/rejects", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [(r["name"], r["es"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/records").collect()] == [("ok", 60, 1.5)]
    assert sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == ["junk", "null", "undated"]


def test_replay_in_steps_and_after_a_restart(spark, tmp_path):
    spark.dataSource.register(TickReplay)
    events = spark.read.parquet(f"{SF}/events.parquet")
    make = lambda step: spark.readStream.format("tick_replay").option("path", f"{SF}/events.parquet").option("step", step).option("tasks", 3).option("progress", f"{tmp_path}/progress").load()
    assert spark.read.format("tick_replay").option("path", f"{SF}/events.parquet").load().count() == events.count()
    sizes = []

    def sink(batch, number):
        batch.select(SCHEMA.split()[0], "ts").write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")
        sizes.append(batch.count())
        if len(sizes) == 3:
            raise RuntimeError("stop")

    start = lambda f: make(4 * 86_400).writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
    query = start(sink)
    with pytest.raises(Exception, match="stop"):
        query.awaitTermination(60)
    assert len(sizes) == 3 and 0 < max(sizes) < events.count() / 3
    query = start(lambda batch, number: batch.select("event_id", "ts").write.mode("overwrite").parquet(f"{tmp_path}/out/{number}"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.select("event_id", "ts").collect()))


def test_view_over_the_replay(spark):
    spark.dataSource.register(TickReplay)
    rows = spark.read.format("tick_replay").option("path", f"file://{SF}/events.parquet").load()
    assert rows.count() == table(spark, SF, "ticks").count()
