"""Queries with sequential semantics and user code; hand-computed tests stand in for SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions.cron import cron_error, cron_next, cron_text
from jobloom.functions.processors import process_batches, process_each
from jobloom.operators import lifecycle as M
from jobloom.plans.registry import query
from jobloom.sources.tables import DAY, NOW
from jobloom.streaming import metrics as S
from jobloom.streaming import policies as T

c = F.col


def _decided(v, policy):
    return T.run_batch(v.events.select("id", "dedup_key", "occurred_at"), "dedup_key", "occurred_at", policy)


@query("t4_dedup_reject")
def _(v):
    return _decided(v, T.dedup(3 * DAY))


@query("t4_dedup_extend")
def _(v):
    return _decided(v, T.dedup(3 * DAY, "extend"))


@query("t4_dedup_replace")
def _(v):
    return _decided(v, T.dedup(3 * DAY, "replace"))


@query("t6_token_bucket")
def _(v):
    return _decided(v, T.token_bucket(2, 1 / 86400))


@query("t7_fixed_window")
def _(v):
    return _decided(v, T.fixed_window(2, 5 * DAY))


@query("t8_sliding_log")
def _(v):
    return _decided(v, T.sliding_log(2, 5 * DAY))


@query("t10_two_sweeps")
def _(v):
    beats = v.jobs.where("stored_state = 'active'").select("id", "heartbeat_at")
    sweeps = F.explode(F.array(*[F.lit(NOW + k * DAY) for k in range(2)])).alias("at")
    rows = beats.select("id", c("heartbeat_at").alias("at"), c("heartbeat_at").alias("signed")).unionByName(
        beats.select("id", sweeps).withColumn("signed", -c("at"))
    )
    # In order of time, beats first; the sign tells beats from sweeps.
    order = rows.withColumn("kind", (c("signed") < 0).cast("int"))
    return T.run_batch(order, "id", "at", T.two_sweeps(30 * DAY), "kind", "signed")


@query("t13_released", """, done AS (SELECT id FROM jobs WHERE stored_state = 'active' AND queue IN ('q1', 'q2')),
open_edges AS (SELECT DISTINCT job_id FROM dependencies WHERE dependency_id NOT IN (SELECT job_id FROM completions UNION SELECT id FROM done))
SELECT DISTINCT job_id FROM dependencies WHERE dependency_id IN (SELECT id FROM done) AND job_id NOT IN (SELECT job_id FROM open_edges)""")  # fmt: skip
def _(v):
    finished = v.jobs.where("stored_state = 'active' and queue in ('q1', 'q2')").select("id")
    return S.released(v.dependencies, v.completions, finished)


@query("t15_successors", f"""SELECT id, {NOW} + 3600000 * (attempts + 1) AS run_at, attempts + 1 AS runs FROM jobs
    WHERE stored_state = 'completed' AND attempts + 1 < 3 AND ({NOW} + 3600000 * (attempts + 1) <= {NOW + 7200000})""")  # fmt: skip
def _(v):
    done = v.jobs.where("stored_state = 'completed'").select(
        "id", ((c("attempts") + 1) * 3600000).alias("every"), c("attempts").alias("runs"),
        F.lit(3).alias("max_runs"), F.lit(NOW + 7200000).alias("end_at"),
    )
    return M.repeat_successors(done, NOW).select("id", c("run_at").cast("bigint").alias("run_at"), "runs")


@query("t16_batches", """SELECT id, (row_number() OVER (PARTITION BY queue ORDER BY id) - 1) // 50 AS batch FROM log WHERE event_type = 'pushed'""")
def _(v):
    return S.batches(v.events.where("event_type = 'pushed'").select("id", "queue"), "queue", "id", 50).select("id", "batch")


@query("s20_prometheus", """SELECT 'jobs_completed{queue="' || queue || '"} ' || count(*) AS line FROM completions GROUP BY queue""")
def _(v):
    return S.prometheus(v.completions.groupBy("queue").agg(F.count("*").alias("n")), "jobs_completed", "queue", "n")


@query("s23_forwarded", "SELECT 'fwd:q1:' || id AS id FROM jobs WHERE queue = 'q1'")
def _(v):
    return S.forwarded(v.jobs, "q1").select("id")


@query("x6_cron_next")
def _(v):
    at = F.lit(NOW).cast("bigint")
    return v.crons.select(
        "name", "schedule", cron_next("schedule", at, "zone").alias("next_run"), cron_error("schedule", "zone").alias("error"),
        cron_text("schedule").alias("text"),
    )


@query("t14_cron_tick", f"""SELECT name, CASE WHEN executions >= max_limit THEN 'removed'
    WHEN skip_without_worker AND queue NOT IN ('q0', 'q1', 'q2', 'q3') THEN 'no-worker'
    WHEN {NOW} - last_fired < 0.8 * coalesce(repeat_every, 60000) THEN 'overlap' ELSE 'fired' END AS outcome,
    executions + CASE WHEN outcome = 'fired' THEN 1 ELSE 0 END AS executions,
    CASE WHEN repeat_every IS NOT NULL AND outcome <> 'removed' THEN next_run + repeat_every * greatest(1, CAST(ceil(({NOW} + 1 - next_run) / CAST(repeat_every AS DOUBLE)) AS BIGINT)) END
        AS next_interval_run
    FROM crons WHERE next_run <= {NOW}""")  # fmt: skip
def _(v):
    workers = v.jobs.select("queue").where("queue in ('q0', 'q1', 'q2', 'q3')").distinct()
    ticked = M.cron_tick(v.crons, workers, NOW)
    return ticked.select("name", "outcome", "executions", F.when(c("repeat_every").isNotNull(), c("next_run")).alias("next_interval_run"))


@query("t18_queue_threshold", f""", days AS (SELECT queue, occurred_at // {DAY} AS day, count(*) AS waiting FROM log GROUP BY ALL)
SELECT queue, day, waiting FROM days QUALIFY waiting >= 20 AND coalesce(lag(waiting) OVER (PARTITION BY queue ORDER BY day), 0) < 20""")  # fmt: skip
def _(v):
    day = F.floor(c("occurred_at") / DAY).alias("day")
    return S.threshold_alerts(v.events.groupBy("queue", day).agg(F.count("*").alias("waiting")), "queue", "day", "waiting", 20)


@query("t18_queue_idle")
def _(v):
    day = (F.floor(c("occurred_at") / DAY) * DAY).cast("bigint").alias("at")
    sizes = v.events.groupBy("queue", day).agg(F.count_if(c("event_type") == "pushed").alias("busy"))
    # The sign tells idle checks from busy ones.
    checks = sizes.withColumn("id", c("at")).withColumn("signed", F.when(c("busy") == 0, c("at")).otherwise(-c("at")))
    return T.run_batch(checks, "queue", "at", T.lasting(DAY), "id", "signed")


@query("t4_dedup_owned")
def _(v):
    owner = F.element_at(F.array(F.lit("queued"), F.lit("active"), F.lit("gone")), (c("id") % 3 + 1).cast("int"))
    rows = v.events.select("id", "dedup_key", "occurred_at", owner.alias("owner"))
    return T.run_batch(rows, "dedup_key", "occurred_at", T.dedup_owned(3 * DAY, "replace"), also="owner")


@query("d1_processed", "SELECT id, CAST(progress * 2 AS VARCHAR) AS result, NULL::VARCHAR AS error FROM jobs WHERE stored_state = 'active'")
def _(v):
    return process_each(v.jobs.where("stored_state = 'active'").select("id", "progress"), lambda job: job["progress"] * 2)


@query("d2_processed_batches", "SELECT id, CAST(progress + 1 AS VARCHAR) AS result FROM jobs WHERE stored_state = 'active'")
def _(v):
    jobs = v.jobs.where("stored_state = 'active'").select("id", "progress")
    return process_batches(jobs, lambda batch: [job["progress"] + 1 for job in batch], 100)
