"""Counts, series and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.predicates import logical_state
from jobloom.sources.tables import REASONS

c = F.col
STATES = ["waiting", "prioritized", "delayed", "active", "completed", "failed", "waiting_children"]
#: Bounds of the latency histogram.
BOUNDS = [0.1, 0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


def state_counts(stated: DataFrame, queues: DataFrame) -> DataFrame:
    """A1: a column for each state, a row for each requested queue, zeros for empty queues; one pass over the jobs."""
    sums = [F.count_if(c("state") == s.replace("_", "-")).alias(s) for s in STATES]
    return queues.select("queue").join(stated.groupBy("queue").agg(*sums), "queue", "left").fillna(0, STATES)


def paused_view(counts: DataFrame, queue_state: DataFrame) -> DataFrame:
    """A paused queue's waiting and prioritized jobs count as paused."""
    both = counts.join(queue_state.select("queue", "paused"), "queue", "left")
    flag = F.coalesce("paused", F.lit(False))
    return both.select(
        "queue",
        flag.alias("is_paused"),
        F.when(flag, 0).otherwise(c("waiting")).alias("waiting"),
        F.when(flag, 0).otherwise(c("prioritized")).alias("prioritized"),
        F.when(flag, c("waiting") + c("prioritized")).otherwise(0).alias("paused"),
        "delayed",
        "active",
        "completed",
        "failed",
    )


def queue_summary(jobs: DataFrame, dead: DataFrame, queue_state: DataFrame, now: int) -> DataFrame:
    """F1, A1 and A8 in one plan."""
    return paused_view(state_counts(with_state(jobs, dead, now), queue_state), queue_state)


def with_state(jobs: DataFrame, dead: DataFrame, now: int) -> DataFrame:
    """F1 over all jobs: the dead-letter queue is asked by a left join."""
    marks = dead.select(c("job_id").alias("id"), F.lit(True).alias("is_dead"))
    joined = jobs.join(marks, "id", "left")
    return joined.withColumn("state", logical_state(now, F.coalesce("is_dead", F.lit(False)))).drop("is_dead")


def dlq_stats(dlq: DataFrame, queue_state: DataFrame, now: int) -> DataFrame:
    """Per queue totals, all reasons, what may be retried (whether or not retries are on), expired, first and last."""
    joined = dlq.join(queue_state.select("queue", "max_auto_retries"), "queue")
    retry = (c("next_retry_at") <= now) & (c("retry_count") < c("max_auto_retries"))
    return joined.groupBy("queue").agg(
        F.count("*").alias("total"),
        *[F.count_if(c("reason") == r).alias(r) for r in REASONS],
        F.count_if(retry).alias("pending_retry"),
        F.count_if(c("expires_at") <= now).alias("expired"),
        F.min("entered_at").alias("oldest_entry"),
        F.max("entered_at").alias("newest_entry"),
    )


def minute_buckets(events: DataFrame, unit: int = 60000) -> DataFrame:
    """A10: terminal outcomes per queue, type and minute; a failed attempt that is retried is not one.

    Minutes are whole divisions towards zero, so those before 1970 are numbered as in SQL.
    """
    ends = events.where("event_type = 'completed' or (event_type = 'failed' and terminal)")
    minute = F.expr(f"occurred_at div {unit}").alias("minute")
    return ends.groupBy("queue", "event_type", minute).agg(F.count("*").alias("n"))


def merge_buckets(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored buckets with additions."""
    return stored.unionByName(added).groupBy("queue", "event_type", "minute").agg(F.sum("n").alias("n"))


def totals(buckets: DataFrame) -> DataFrame:
    """All-time totals, and the newest bucket's minute and count."""
    return buckets.groupBy("queue", "event_type").agg(
        F.sum("n").alias("total"), F.max("minute").alias("prev_minute"), F.max_by("n", "minute").alias("prev_n")
    )


def retained(buckets: DataFrame, points: int) -> DataFrame:
    """The newest minutes up to a number, counted from each series' last one."""
    last = F.max("minute").over(Window.partitionBy("queue", "event_type"))
    return buckets.withColumn("last", last).where(c("minute") > c("last") - points).drop("last")


def dense_series(buckets: DataFrame, points: int) -> DataFrame:
    """A row for every minute from the newest back to the oldest, at most so many; position 0 is the newest."""
    span = buckets.groupBy("queue", "event_type").agg(F.max("minute").alias("newest"), F.min("minute").alias("oldest"))
    first = F.greatest("oldest", c("newest") - (points - 1))
    minutes = span.select("queue", "event_type", "newest", F.explode(F.sequence(first, "newest")).alias("minute"))
    return minutes.join(buckets, ["queue", "event_type", "minute"], "left").select(
        "queue", "event_type", "minute", (c("newest") - c("minute")).alias("position"), F.coalesce("n", F.lit(0)).alias("n")
    )


def series_page(series: DataFrame, start: int, end: int) -> DataFrame:
    """Positions start to end, both included; -1 is to the last."""
    return series.where(c("position") >= start) if end == -1 else series.where(c("position").between(start, end))


def histogram(values: DataFrame, key: str, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts, a value on a bound belongs to it; sum and count. One pass."""
    bounds = BOUNDS if bounds is None else bounds
    cells = [F.count_if(c(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return values.groupBy(key).agg(*cells, F.count(value).alias("n"), F.sum(value).alias("total"))


def bucket_percentile(p: float, bounds: list[float] | None = None) -> Column:
    """The smallest bound whose cumulative count reaches p percent; beyond all, the last; 0 when empty."""
    bounds = BOUNDS if bounds is None else bounds
    target = c("n") * (p / 100)
    found = [F.when(c(f"le_{i}") >= target, F.lit(float(b))) for i, b in enumerate(bounds)]
    return F.when(c("n") == 0, 0.0).otherwise(F.coalesce(*found, F.lit(float(bounds[-1]))))


def keep_newest(rows: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """At most n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("keep_rank", rank).where(c("keep_rank") <= n).drop("keep_rank")


def smoothed_rate(samples: DataFrame, key: str, at: str, n: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially smoothed events per second, in order of time; the first sample with a rate seeds it.

    A sample less than 0.1 s after the last one used is carried over to the next. The fold runs over one key's
    samples, so keys should be series of bounded length, such as minutes of a queue.
    """
    ordered = F.array_sort(F.collect_list(F.struct(at, n)))
    first = F.struct(
        F.lit(0.0).alias("rate"), F.lit(0).cast("double").alias("held"), F.lit(None).cast("bigint").alias("last")
    )

    def step(s: Column, x: Column) -> Column:
        held = s["held"] + x[n]
        gone = (x[at] - s["last"]) / 1000
        rate = held / gone
        new = F.when(s["rate"] == 0, rate).otherwise(alpha * rate + (1 - alpha) * s["rate"])
        waits = gone < 0.1
        return F.struct(
            F.when(s["last"].isNull() | waits, s["rate"]).otherwise(new).alias("rate"),
            F.when(s["last"].isNull(), F.lit(0.0)).when(waits, held).otherwise(F.lit(0.0)).alias("held"),
            F.when(s["last"].isNull() | ~waits, x[at]).otherwise(s["last"]).alias("last"),
        )

    folded = F.aggregate(ordered, first, step, lambda s: F.round(s["rate"], 2))
    return samples.groupBy(key).agg(folded.alias("rate"))
