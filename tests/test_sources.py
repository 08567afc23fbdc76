"""Readers and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bidloom.operators import jobs
from bidloom.sources import readers
from bidloom.streaming import jobs as streams


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    tree = readers.code_tree(spark, file("t.json", json.dumps({"code_to_path": {"62": ".1."}, "path_to_name": {}})))
    assert tree.collect() == [("62", ".1.")]
    with pytest.raises(Exception, match="JSON object"):
        readers.code_tree(spark, file("l.json", "[1]")).collect()
    assert readers.eval_pairs(spark, file("e.json", '[{"description": "a", "expected_fit": 12}]')).collect() == [("a", 10.0)]
    assert readers.eval_pairs(spark, file("e.csv", "description,expected_fit\na,-1\n")).collect() == [("a", 0.0)]
    assert sorted(readers.score_file(spark, file("s.json", '{"1": 2, "2": 3.5}')).collect()) == [("1", 2.0), ("2", 3.5)]
    assert readers.score_file(spark, file("s.csv", "number,score\n 7 ,1.5\n")).collect() == [("7", 1.5)]
    assert readers.score_file(spark, file("s.txt", "  ")).count() == 0
    assert readers.dataset(spark, str(tmp_path / "missing.json")).count() == 0
    one = readers.dataset(spark, file("d.json", json.dumps({"procurements": [{"id": 1, "number": "5", "nmck": 2.5, "files": [{"name": "a", "url": "u"}]}]})))
    assert one.select("id", "number", "nmck", F.col("files")[0]["url"]).collect() == [(1, "5", 2.5, "u")]
    with pytest.raises(ValueError, match="empty"):
        readers.text_document(spark, file("c.txt", " \n"))


def test_incremental_stream(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "b", "p")], "id long, number string, source_platform string")
    rows.coalesce(1).write.parquet(f"{base}/in/cards.parquet")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"{base}/in/cards.parquet")
    streams.insert_new_cards(read(), f"{base}/store", f"{base}/cp").awaitTermination()
    rows.unionByName(spark.createDataFrame([(4, "c", "p")], rows.schema)).write.mode("append").parquet(f"{base}/in/cards.parquet")
    seen = []
    streams.insert_new_cards(read(), f"{base}/store", f"{base}/cp", after=lambda df: seen.append(df.count())).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/store").collect()) == [1, 3, 4] and sum(seen) == 1


def test_lease_stream(spark, tmp_path):
    """A released lease ends, one that times out is queued again with its priority, and the run ends by itself."""
    source, schema = str(tmp_path / "in"), "member string, kind string, at timestamp, priority double"
    at = lambda seconds: datetime(2026, 8, 5, 12) + timedelta(seconds=seconds)
    batches = [[("proc:1", "claim", at(0), 5.0), ("proc:2", "claim", at(1), None), ("proc:4", "claim", at(2), 1.0)], [("proc:2", "release", at(60), None), ("proc:4", "claim", at(500), 2.0)], [("proc:3", "claim", at(900), 3.0)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)

        def keep(df, batch_id, n=n):
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/run={n}/batch={batch_id}")

        out = streams.lease_events(spark.readStream.schema(schema).parquet(source), 600, 7.0)
        out.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("member", "event", "priority").collect()))
    assert got == [("proc:1", "claimed", 5.0), ("proc:1", "requeued", 5.0), ("proc:2", "claimed", 7.0), ("proc:2", "released", 7.0), ("proc:3", "claimed", 3.0), ("proc:4", "claimed", 1.0), ("proc:4", "claimed", 2.0)]


def test_result_stream(spark, tmp_path):
    spark.createDataFrame([('{"procurement_id": 1, "score": 2.0}',), ("junk",)], "value string").write.text(str(tmp_path / "in"))
    calls = []

    def apply(df):
        calls.append(df.count())
        if len(calls) == 1:
            raise RuntimeError("once")

    streams.result_stream(spark.readStream.text(str(tmp_path / "in")), apply, str(tmp_path / "cp")).awaitTermination()
    assert calls[:2] == [1, 1]
    assert streams.run_platforms({"a": lambda: 1 / 0, "b": lambda: None}) == {"a": "division by zero"}
    assert jobs.result_messages(spark.createDataFrame([(1, 2.0, 3.0, 1.0, 5.0, "m")], jobs.RESULT_SCHEMA)).first()["value"].startswith('{"procurement_id":1')


def test_latest_jobs_stream_writes_a_shared_table(spark, tmp_path):
    schema = "procurement_id long, priority double, seq long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    write([(1, 1.0, 5), (2, 2.0, 1), (3, None, 1)])
    write([(1, 9.0, 2), (2, 7.0, 3)])  # an earlier version of 1 that comes late
    streams.latest_jobs_stream(read(), ["seq"], path, checkpoint).awaitTermination()
    write([(3, 4.0, 2), (4, 6.0, 1)])
    streams.latest_jobs_stream(read(), ["seq"], path, checkpoint).awaitTermination()
    out = streams.latest_jobs_table(spark, path)
    assert sorted(map(tuple, out.collect())) == [(1, 1.0), (2, 7.0), (3, 4.0), (4, 6.0)]
    assert all(f.startswith("file:") and path in f for f in spark.read.parquet(path).inputFiles())
    assert spark.read.parquet(path).where("batch = 2").count() == 2  # only what the batch changed
