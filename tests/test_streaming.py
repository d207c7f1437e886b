"""Streams over files give what the batch operators give."""

from datetime import datetime

from pyspark.sql import functions as F

from jobloom.operators.aggregates import minute_buckets
from jobloom.streaming import metrics as S

EVENT = "id bigint, queue string, event_type string, terminal boolean, ts timestamp"


def rows():
    return [
        (i, f"q{i % 2}", "completed" if i % 3 else "failed", i % 2 == 0, datetime(2024, 1, 1, 0, i // 4, i % 60))
        for i in range(48)
    ]


def drained(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_minute_metrics(spark, tmp_path):
    batch = spark.createDataFrame(rows(), EVENT)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(S.minute_metrics(stream), "minutes", "complete")
    want = minute_buckets(batch.withColumn("occurred_at", F.unix_millis("ts")))
    key = lambda r: (r.queue, r.event_type, r.minute, r.n)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_latest_per_micro_batch(spark, tmp_path):
    batch = spark.createDataFrame(rows(), EVENT)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = S.write_latest(stream, lambda frame, n: seen.extend(frame.collect()), "queue", "id", str(tmp_path / "at"))
    query.processAllAvailable()
    query.stop()
    assert {r.queue: r.id for r in seen} == {"q0": 46, "q1": 47}


def test_released(spark):
    deps = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "job_id string, dependency_id string")
    done = spark.createDataFrame([("y",)], "job_id string")
    finished = spark.createDataFrame([("x",)], "id string")
    assert sorted(r.job_id for r in S.released(deps, done, finished).collect()) == ["a", "b"]
