"""Streaming minute metrics and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from jobloom.operators.joins import unmet
from jobloom.operators.ranking import numbered

c = F.col


def minute_metrics(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Terminal outcomes per queue, type and minute of a stream with a timestamp column `ts`."""
    ends = events.where("event_type = 'completed' or (event_type = 'failed' and terminal)")
    windowed = ends.withWatermark("ts", lateness).groupBy("queue", "event_type", F.window("ts", "1 minute"))
    return windowed.agg(F.count("*").alias("n")).select(
        "queue", "event_type", F.floor(F.unix_millis("window.start") / 60000).alias("minute"), "n"
    )


def failure_ratios(events: DataFrame, span: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Share of failures in sliding windows."""
    windowed = events.withWatermark("ts", span).groupBy("queue", F.window("ts", span, slide))
    bad = F.count_if(c("event_type") == "failed")
    return windowed.agg(bad.alias("bad"), F.count("*").alias("n")).withColumn("ratio", c("bad") / c("n"))


def first_of_key(events: DataFrame, key: str, ttl: str) -> DataFrame:
    """T4, reject only: the first event of a key within the time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def released(dependencies: DataFrame, completions: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs whose last open dependency is among the finished ids of a micro-batch."""
    touched = dependencies.join(finished.select(c("id").alias("dependency_id")), "dependency_id", "left_semi")
    done = completions.select("job_id").union(finished.select(c("id").alias("job_id"))).distinct()
    candidates = touched.select("job_id").distinct()
    return candidates.join(unmet(dependencies.join(candidates, "job_id", "left_semi"), done), "job_id", "left_anti")


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Rows of a key numbered into batches of at most so many, in order."""
    return numbered(rows, key, [c(order)], "number").withColumn("batch", F.floor((c("number") - 1) / size)).drop("number")


def threshold_alerts(sizes: DataFrame, key: str, at: str, size: str, most: int) -> DataFrame:
    """Where a key's size reaches the threshold from below; it alerts again only after a check below."""
    before = F.lag(size).over(Window.partitionBy(key).orderBy(at))
    return sizes.withColumn("size_before", before).where((c(size) >= most) & (F.coalesce("size_before", F.lit(0)) < most)).drop("size_before")


def write_latest(stream: DataFrame, write: Callable[[DataFrame, int], None], key: str, order: str, at: str) -> StreamingQuery:
    """Each micro-batch's last row of a key, handed to `write`; a repeated batch has the same number."""

    def each(frame: DataFrame, number: int) -> None:
        last = Window.partitionBy(key).orderBy(c(order).desc())
        write(frame.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n"), number)

    return stream.writeStream.option("checkpointLocation", at).foreachBatch(each).start()


def forwarded(jobs: DataFrame, queue: str) -> DataFrame:
    """One queue's jobs for another store; the id tells the origin, so that a repeat is recognised."""
    return jobs.where(c("queue") == queue).withColumn("id", F.concat_ws(":", F.lit("fwd"), "queue", "id"))


def prometheus(counts: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """One text line for each row."""
    return counts.select(
        F.format_string(f'%s{{{label}="%s"}} %s', F.lit(name), c(label), c(value).cast("string")).alias("line")
    )
