"""Job-domain views over the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all registered queries, in epoch milliseconds, near the middle of the order dates.
NOW = 892771200000
DAY = 86400000
#: Schedules and zones of the made-up crons.
SCHEDULES = ["0 9 * * *", "30 30 2 * * *", "*/15 * * * *", "@weekly", "not a cron"]
ZONES = ["America/New_York", "Europe/Rome", "UTC"]
#: Failure reasons in the order of their numbers.
REASONS = ["explicit_fail", "max_attempts_exceeded", "timeout", "stalled", "ttl_expired", "worker_lost", "unknown"]


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone, whatever the session's zone."""
    clock = F.hour(ts) * 3600000 + F.minute(ts) * 60000 + (F.date_part(F.lit("SECOND"), ts) * 1000).cast("int")
    return (F.unix_date(ts.cast("date")).cast("bigint") * DAY + clock).cast("bigint")


def padded(key: Column) -> Column:
    return F.lpad(key.cast("string"), 12, "0")


class Views:
    """The views over one directory of parquet tables; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def jobs(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        status = F.col("o_orderstatus")
        stored = F.when(status == "F", "completed").when(status == "P", "active").otherwise("pending")
        base = self.table("orders").select(
            padded(k).alias("id"),
            F.concat(F.lit("q"), (c % 8).cast("string")).alias("queue"),
            F.concat(F.lit("n"), (k % 4).cast("string")).alias("name"),
            (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
            millis(F.col("o_orderdate")).alias("created_at"),
            (k % 7).alias("wait_days"),
            stored.alias("stored_state"),
            (k % 10 == 0).alias("lifo"),
            F.when(c % 3 != 0, F.concat(F.lit("g"), (c % 5).cast("string"))).alias("group_id"),
            k.cast("bigint").alias("group_order"),
            F.when(k % 4 == 0, F.lit(500 * DAY).cast("bigint")).alias("ttl"),
            (k % 4).cast("int").alias("attempts"),
            F.lit(3).alias("max_attempts"),
            (k % 3).cast("int").alias("stall_count"),
            F.when(k % 3 == 0, F.lit(30 * DAY).cast("bigint")).alias("timeout"),
            F.when(k % 5 == 0, F.lit(40 * DAY).cast("bigint")).alias("stall_timeout"),
            F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("custom_id"),
            F.concat(F.lit("u"), (c % 1000).cast("string")).alias("unique_key"),
            (k % 101).cast("int").alias("progress"),
            F.col("o_totalprice").alias("price"),
        )
        started = F.when(F.col("stored_state") != "pending", F.col("run_at") + 3600000)
        return (
            base.withColumn("run_at", F.col("created_at") + F.col("wait_days") * DAY)
            .withColumn("started_at", started)
            .withColumn("heartbeat_at", F.when(F.col("stored_state") == "active", F.col("run_at") + 3600000 + F.col("wait_days") * 10 * DAY))
            .withColumn("completed_at", F.when(F.col("stored_state") == "completed", F.col("run_at") + 7200000))
            .drop("wait_days")
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        """Acyclic: a job depends on an earlier one."""
        return self._edges.where("job_id > dependency_id")

    @cached_property
    def cyclic(self) -> DataFrame:
        """The same rule without the order, so that cycles occur."""
        return self._edges

    @cached_property
    def _edges(self) -> DataFrame:
        lines = self.table("lineitem").where("l_linenumber = 1 and l_orderkey % 2 = 0")
        pairs = lines.select(padded(F.col("l_orderkey")).alias("job_id"), padded(F.col("l_partkey")).alias("dependency_id"))
        ids = self.table("orders").select(padded(F.col("o_orderkey")).alias("dependency_id"))
        known = pairs.distinct().join(ids, "dependency_id", "left_semi").select("job_id", "dependency_id")
        back = known.where("job_id like '%50'").select(F.col("dependency_id").alias("job_id"), F.col("job_id").alias("dependency_id"))
        return known.unionByName(back).distinct()

    @cached_property
    def completions(self) -> DataFrame:
        done = self.jobs.where("stored_state = 'completed'")
        return done.select(F.col("id").alias("job_id"), "queue", "completed_at", F.col("price").alias("result"))

    @cached_property
    def events(self) -> DataFrame:
        kind = F.col("event_type")
        named = (
            F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "view", "pulled")
            .when(kind == "click", "progress").otherwise("pushed")
        )
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("q"), (F.col("user_id") % 8).cast("string")).alias("queue"),
            named.alias("event_type"),
            (F.col("event_id") % 2 == 0).alias("terminal"),
            F.concat_ws(":", F.col("user_id").cast("string"), kind).alias("dedup_key"),
            millis(F.col("ts")).alias("occurred_at"),
            F.col("value"),
            (F.col("event_id") % 997).alias("tx"),
        )

    @cached_property
    def dlq(self) -> DataFrame:
        n = F.col("l_linenumber")
        at = millis(F.col("l_shipdate"))
        return self.table("lineitem").where("l_returnflag = 'R'").select(
            (F.col("l_orderkey") * 10 + n).cast("bigint").alias("entry_id"),
            padded(F.col("l_orderkey")).alias("job_id"),
            F.concat(F.lit("q"), (F.col("l_suppkey") % 8).cast("string")).alias("queue"),
            at.alias("entered_at"),
            F.element_at(F.array(*[F.lit(r) for r in REASONS]), (n % 7 + 1).cast("int")).alias("reason"),
            (n % 4).cast("int").alias("retry_count"),
            F.when(n % 2 == 0, at + 10 * DAY).alias("next_retry_at"),
            F.when(n % 3 != 0, at + 40 * DAY).alias("expires_at"),
        )

    @cached_property
    def dead(self) -> DataFrame:
        """Jobs that stand in the dead-letter queue."""
        return self.dlq.select("job_id").distinct()

    @cached_property
    def queue_state(self) -> DataFrame:
        rows = [(f"q{i}", i in (2, 5), i * 40, bool(i % 2), 2) for i in range(10)]
        return self.spark.createDataFrame(rows, "queue string, paused boolean, concurrency int, auto_retry boolean, max_auto_retries int")

    @cached_property
    def groups(self) -> DataFrame:
        rows = [(f"g{i}", i == 3, 2000 + 5 * i if i else None, 30 if i % 2 else None, i, None if i == 4 else 100 - i) for i in range(7)]
        return self.spark.createDataFrame(
            rows, "group_id string, paused boolean, concurrency_limit int, rate_limit int, rate_count int, last_served int"
        )

    @cached_property
    def crons(self) -> DataFrame:
        """A cron for each customer: by schedule, by interval, and some whose schedule can't be read."""
        k = F.col("c_custkey")
        schedules = F.array(*[F.lit(s) for s in SCHEDULES], F.lit(None).cast("string"))
        zones = F.array(*[F.lit(z) for z in ZONES], F.lit(None).cast("string"))
        none = F.lit(None).cast("bigint")
        return self.table("customer").select(
            F.concat(F.lit("cron"), k.cast("string")).alias("name"),
            F.concat(F.lit("q"), (k % 8).cast("string")).alias("queue"),
            F.get(schedules, (k % 6).cast("int")).alias("schedule"),
            F.get(zones, (k % 4).cast("int")).alias("zone"),
            F.when(k % 6 == 5, (k % 5 + 1) * 3600000).otherwise(none).alias("repeat_every"),
            (NOW + (k % 11 - 5) * 3600000).cast("bigint").alias("next_run"),
            (k % 5).cast("int").alias("executions"),
            F.when(k % 3 == 0, 4).alias("max_limit"),
            F.when(k % 2 == 0, NOW - (k % 7) * 900000).otherwise(none).alias("last_fired"),
            (k % 4 == 1).alias("skip_without_worker"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        """Turns of a conversation as a chain of jobs: each depends on the one before."""
        turn = self.table("conversations").select("conv_id", "turn", "role")
        return turn.withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


#: The same views for DuckDB.
VIEWS_SQL = f"""
base_jobs AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, 'q' || (o_custkey % 8) AS queue,
    'n' || (o_orderkey % 4) AS name, 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
    epoch_ms(o_orderdate) AS created_at,
    epoch_ms(o_orderdate) + (o_orderkey % 7) * CAST({DAY} AS BIGINT) AS run_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'pending' END AS stored_state,
    o_orderkey % 10 = 0 AS lifo, CASE WHEN o_custkey % 3 <> 0 THEN 'g' || (o_custkey % 5) END AS group_id,
    o_orderkey AS group_order, CASE WHEN o_orderkey % 4 = 0 THEN CAST(500 AS BIGINT) * {DAY} END AS ttl,
    CAST(o_orderkey % 4 AS INTEGER) AS attempts, 3 AS max_attempts, CAST(o_orderkey % 3 AS INTEGER) AS stall_count,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(30 AS BIGINT) * {DAY} END AS timeout,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(40 AS BIGINT) * {DAY} END AS stall_timeout,
    CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_orderkey END AS custom_id, 'u' || (o_custkey % 1000) AS unique_key,
    CAST(o_orderkey % 101 AS INTEGER) AS progress, o_totalprice AS price, o_orderkey % 7 AS wait_days FROM orders),
jobs AS (SELECT *, CASE WHEN stored_state <> 'pending' THEN run_at + 3600000 END AS started_at,
    CASE WHEN stored_state = 'active' THEN run_at + 3600000 + wait_days * CAST(10 AS BIGINT) * {DAY} END AS heartbeat_at,
    CASE WHEN stored_state = 'completed' THEN run_at + 7200000 END AS completed_at FROM base_jobs),
known AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS job_id,
    lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS dependency_id FROM lineitem
    WHERE l_linenumber = 1 AND l_orderkey % 2 = 0 AND l_partkey IN (SELECT o_orderkey FROM orders)),
cyclic AS (SELECT job_id, dependency_id FROM known UNION SELECT dependency_id, job_id FROM known WHERE job_id LIKE '%50'),
dependencies AS (SELECT * FROM cyclic WHERE job_id > dependency_id),
completions AS (SELECT id AS job_id, queue, completed_at, price AS result FROM jobs WHERE stored_state = 'completed'),
log AS (SELECT event_id AS id, 'q' || (user_id % 8) AS queue, CASE event_type WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pulled' WHEN 'click' THEN 'progress' ELSE 'pushed' END AS event_type,
    event_id % 2 = 0 AS terminal, user_id || ':' || event_type AS dedup_key, epoch_ms(ts) AS occurred_at, value,
    event_id % 997 AS tx FROM events),
dlq AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS job_id,
    'q' || (l_suppkey % 8) AS queue, epoch_ms(l_shipdate) AS entered_at,
    [{", ".join(f"'{r}'" for r in REASONS)}][l_linenumber % 7 + 1] AS reason,
    CAST(l_linenumber % 4 AS INTEGER) AS retry_count,
    CASE WHEN l_linenumber % 2 = 0 THEN epoch_ms(l_shipdate) + CAST(10 AS BIGINT) * {DAY} END AS next_retry_at,
    CASE WHEN l_linenumber % 3 <> 0 THEN epoch_ms(l_shipdate) + CAST(40 AS BIGINT) * {DAY} END AS expires_at
    FROM lineitem WHERE l_returnflag = 'R'),
dead AS (SELECT DISTINCT job_id FROM dlq),
crons AS (SELECT 'cron' || c_custkey AS name, 'q' || (c_custkey % 8) AS queue,
    [{", ".join(f"'{s}'" for s in SCHEDULES)}, NULL][c_custkey % 6 + 1] AS schedule, [{", ".join(f"'{z}'" for z in ZONES)}, NULL][c_custkey % 4 + 1] AS zone,
    CASE WHEN c_custkey % 6 = 5 THEN (c_custkey % 5 + 1) * 3600000 END AS repeat_every,
    {NOW} + (c_custkey % 11 - 5) * 3600000 AS next_run, CAST(c_custkey % 5 AS INTEGER) AS executions,
    CASE WHEN c_custkey % 3 = 0 THEN 4 END AS max_limit,
    CASE WHEN c_custkey % 2 = 0 THEN {NOW} - (c_custkey % 7) * 900000 END AS last_fired, c_custkey % 4 = 1 AS skip_without_worker
    FROM customer),
queue_state AS (SELECT 'q' || i AS queue, i IN (2, 5) AS paused, CAST(i * 40 AS INTEGER) AS concurrency,
    i % 2 = 1 AS auto_retry, 2 AS max_auto_retries FROM range(10) AS r(i)),
groups AS (SELECT 'g' || i AS group_id, i = 3 AS paused, CASE WHEN i > 0 THEN CAST(2000 + 5 * i AS INTEGER) END AS concurrency_limit,
    CASE WHEN i % 2 = 1 THEN 30 END AS rate_limit, CAST(i AS INTEGER) AS rate_count,
    CASE WHEN i <> 4 THEN CAST(100 - i AS INTEGER) END AS last_served FROM range(7) AS r(i)),
chain AS (SELECT conv_id, turn, role, conv_id || ':' || turn AS id FROM conversations),
stated AS (SELECT j.*, CASE WHEN d.job_id IS NOT NULL THEN 'failed' WHEN stored_state <> 'pending' THEN stored_state
    WHEN run_at > {NOW} THEN 'delayed' WHEN priority > 0 THEN 'prioritized' ELSE 'waiting' END AS state
    FROM jobs j LEFT JOIN dead d ON d.job_id = j.id),
blocked AS (SELECT DISTINCT job_id FROM dependencies WHERE dependency_id NOT IN (SELECT job_id FROM completions)),
live AS (SELECT * FROM jobs WHERE stored_state = 'pending' AND run_at <= {NOW}
    AND (ttl IS NULL OR created_at + ttl >= {NOW}) AND id NOT IN (SELECT job_id FROM blocked))
"""
