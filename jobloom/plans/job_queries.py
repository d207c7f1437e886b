"""Queries over jobs: states, filters, pages, claims, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import predicates as P
from jobloom.functions import scalars as X
from jobloom.operators import joins as J
from jobloom.operators import lifecycle as M
from jobloom.operators import ordering as O
from jobloom.operators.aggregates import with_state
from jobloom.plans.registry import query
from jobloom.sources.tables import DAY, NOW

c = F.col
READY_SQL = "priority DESC, CASE WHEN lifo THEN 0 ELSE 1 END, CASE WHEN lifo THEN id END DESC NULLS LAST, CASE WHEN NOT lifo THEN run_at END NULLS FIRST, id"


@query("f1_job_state", "SELECT id, state FROM stated")
def _(v):
    return with_state(v.jobs, v.dead, NOW).select("id", "state")


@query("f2_delayed", f"SELECT id, run_at > {NOW} AS delayed, run_at <= {NOW} AS ready FROM jobs")
def _(v):
    return v.jobs.select("id", P.is_delayed(NOW).alias("delayed"), (~P.is_delayed(NOW)).alias("ready"))


@query("f3_expired", f"SELECT id FROM jobs WHERE ttl IS NOT NULL AND {NOW} > created_at + ttl")
def _(v):
    return v.jobs.where(P.is_expired(NOW)).select("id")


@query("f4_timed_out", f"""SELECT id, coalesce({NOW} > started_at + timeout, FALSE) AS timed_out,
    coalesce({NOW} >= started_at + timeout, FALSE) AS due FROM jobs WHERE stored_state = 'active'""")  # fmt: skip
def _(v):
    active = v.jobs.where("stored_state = 'active'")
    return active.select("id", P.is_timed_out(NOW).alias("timed_out"), P.is_timeout_due(NOW).alias("due"))


@query("f5_can_retry", "SELECT id FROM jobs WHERE attempts < max_attempts")
def _(v):
    return v.jobs.where(P.can_retry()).select("id")


@query("f6_states", f"""SELECT id, queue FROM jobs WHERE stored_state = 'pending'
    AND (run_at > {NOW} OR (run_at <= {NOW} AND priority > 0))""")  # fmt: skip
def _(v):
    return v.jobs.where(P.in_states(["prioritized", "delayed"], NOW)).select("id", "queue")


@query("f8_paused_suppression", """SELECT s.id, s.queue FROM stated s JOIN queue_state q USING (queue)
    WHERE s.state IN ('waiting', 'prioritized') AND NOT q.paused""")  # fmt: skip
def _(v):
    open_queues = v.queue_state.where("not paused")
    stated = with_state(v.jobs, v.dead, NOW).where("state in ('waiting', 'prioritized')")
    return stated.join(F.broadcast(open_queues.select("queue")), "queue", "left_semi").select("id", "queue")


@query("f9_dlq_filter", f"""SELECT entry_id, reason, entered_at FROM dlq WHERE reason = 'timeout'
    AND entered_at <= {NOW} AND entered_at >= {NOW - 400 * DAY} AND expires_at <= {NOW}""")  # fmt: skip
def _(v):
    kept = v.dlq.where((c("reason") == "timeout") & (c("entered_at") <= NOW) & (c("entered_at") >= NOW - 400 * DAY))
    return kept.where(P.is_dlq_expired(NOW)).select("entry_id", "reason", "entered_at")


@query("f9_dlq_filter_strict", f"""SELECT entry_id FROM dlq WHERE entered_at < {NOW} AND entered_at > {NOW - 100 * DAY}
    AND NOT coalesce(expires_at <= {NOW}, FALSE)""")  # fmt: skip
def _(v):
    strict = (c("entered_at") < NOW) & (c("entered_at") > NOW - 100 * DAY)
    return v.dlq.where(strict & ~P.is_dlq_expired(NOW)).select("entry_id")


@query("f11_auto_retry_due", f"""SELECT d.entry_id FROM dlq d JOIN queue_state q USING (queue) WHERE q.auto_retry
    AND d.retry_count < q.max_auto_retries AND d.next_retry_at <= {NOW}""")  # fmt: skip
def _(v):
    return v.dlq.join(F.broadcast(v.queue_state), "queue").where(P.can_auto_retry(NOW)).select("entry_id")


@query("f12_stall_action", f"""SELECT id, CASE WHEN started_at IS NULL OR {NOW} - started_at < 5000
    OR {NOW} - heartbeat_at <= coalesce(stall_timeout, 30000) THEN 'keep' WHEN stall_count + 1 >= 3 THEN 'move_to_dlq' ELSE 'retry' END AS action
    FROM jobs WHERE stored_state = 'active'""")  # fmt: skip
def _(v):
    return v.jobs.where("stored_state = 'active'").select("id", P.stall_action(NOW).alias("action"))


@query("f15_open_groups", """SELECT g.group_id FROM groups g LEFT JOIN (SELECT group_id, count(*) AS n FROM jobs
    WHERE stored_state = 'active' GROUP BY group_id) a USING (group_id) WHERE NOT paused
    AND (concurrency_limit IS NULL OR coalesce(n, 0) < concurrency_limit) AND (rate_limit IS NULL OR rate_count < rate_limit)""")  # fmt: skip
def _(v):
    active = v.jobs.where("stored_state = 'active'").groupBy("group_id").agg(F.count("*").alias("n"))
    return v.groups.join(active, "group_id", "left").where(P.group_open(F.coalesce("n", F.lit(0)))).select("group_id")


@query("f16_webhooks", """SELECT l.id, w.hook FROM log l JOIN (VALUES ('all', TRUE, ['completed', 'failed'], NULL),
    ('one', TRUE, ['failed'], 'q1'), ('off', FALSE, ['failed'], NULL)) AS w(hook, enabled, wanted, for_queue)
    ON w.enabled AND list_contains(w.wanted, l.event_type) AND (w.for_queue IS NULL OR w.for_queue = l.queue)""")  # fmt: skip
def _(v):
    rows = [("all", True, ["completed", "failed"], None), ("one", True, ["failed"], "q1"), ("off", False, ["failed"], None)]
    hooks = v.spark.createDataFrame(rows, "hook string, enabled boolean, wanted array<string>, for_queue string")
    by_event = hooks.withColumn("event_type", F.explode("wanted"))
    pairs = v.events.join(F.broadcast(by_event), "event_type")
    return pairs.where(P.webhook_matches(c("event_type"), c("queue"))).select("id", "hook")


@query("f17_triggers", "SELECT id, 'mail' AS new_job FROM jobs WHERE name = 'n1' AND stored_state = 'completed' AND priority >= 3")
def _(v):
    rules = v.spark.createDataFrame([("n1", "completed", "mail")], "name string, stored_state string, new_job string")
    hits = v.jobs.join(F.broadcast(rules), ["name", "stored_state"]).where("priority >= 3")
    return hits.select("id", "new_job")


@query("f19_name_ttl", f"""SELECT id FROM jobs JOIN (VALUES ('n1', {100 * DAY}), ('n2', 0)) AS t(name, name_ttl) USING (name)
    WHERE stored_state = 'pending' AND name_ttl > 0 AND {NOW} - created_at > name_ttl""")  # fmt: skip
def _(v):
    limits = v.spark.createDataFrame([("n1", 100 * DAY), ("n2", 0)], "name string, name_ttl bigint")
    pending = v.jobs.where("stored_state = 'pending'").join(F.broadcast(limits), "name")
    return pending.where(P.name_ttl_passed(NOW, c("name_ttl"))).select("id")


@query("s1_job_by_id", "SELECT id, queue, state FROM stated WHERE id = '000000000007'")
def _(v):
    one = v.jobs.where(c("id") == "000000000007")
    return with_state(one, v.dead.where(c("job_id") == "000000000007"), NOW).select("id", "queue", "state")


@query("s2_job_by_custom_id", "SELECT id, custom_id FROM jobs WHERE custom_id = 'c8'")
def _(v):
    return v.jobs.where(c("custom_id") == "c8").select("id", "custom_id")


@query("s3_job_result", """SELECT id, result, c.job_id IS NOT NULL AS found FROM jobs j LEFT JOIN completions c ON c.job_id = j.id
    WHERE j.queue = 'q1'""")  # fmt: skip
def _(v):
    done = v.completions.select(c("job_id").alias("id"), "result", F.lit(True).alias("is_found"))
    some = v.jobs.where("queue = 'q1'").select("id").join(done, "id", "left")
    return some.select("id", "result", c("is_found").isNotNull().alias("found"))


@query("s4_progress", "SELECT id, progress FROM jobs WHERE stored_state = 'active'")
def _(v):
    return v.jobs.where("stored_state = 'active'").select("id", "progress")


@query("s5_pending_scan", f"SELECT id, priority FROM jobs WHERE stored_state = 'pending' ORDER BY {READY_SQL} LIMIT 100 OFFSET 50")
def _(v):
    return v.jobs.where("stored_state = 'pending'").orderBy(*O.ready_order()).offset(50).limit(100).select("id", "priority")


@query("s6_active_scan", "SELECT id, started_at FROM jobs WHERE stored_state = 'active' ORDER BY started_at, id LIMIT 100")
def _(v):
    return v.jobs.where("stored_state = 'active'").orderBy("started_at", "id").limit(100).select("id", "started_at")


@query("s7_completed_scan", "SELECT id, completed_at FROM jobs WHERE stored_state = 'completed' ORDER BY completed_at DESC, id DESC LIMIT 100")
def _(v):
    return O.newest(v.jobs.where("stored_state = 'completed'"), "completed_at", 100).select("id", "completed_at")


@query("s8_jobs_by_ids", "SELECT id, queue FROM jobs WHERE id IN (SELECT dependency_id FROM dependencies)")
def _(v):
    return J.by_request(v.jobs, v.dependencies.select(c("dependency_id").alias("id")), ["id"]).select("id", "queue")


@query("s9_live_and_recent", """SELECT id FROM jobs WHERE stored_state <> 'completed' UNION ALL
    SELECT id FROM (SELECT id FROM jobs WHERE stored_state = 'completed' ORDER BY completed_at DESC, id DESC LIMIT 200)""")  # fmt: skip
def _(v):
    done = v.jobs.where("stored_state = 'completed'")
    return v.jobs.where("stored_state <> 'completed'").select("id").unionByName(O.newest(done, "completed_at", 200).select("id"))


@query("s11_queue_model", """SELECT j.id, j.stored_state, q.paused, c.result FROM jobs j JOIN queue_state q USING (queue)
    LEFT JOIN completions c ON c.job_id = j.id WHERE j.queue = 'q2'""")  # fmt: skip
def _(v):
    policy = v.queue_state.select("queue", "paused")
    results = v.completions.where("queue = 'q2'").select(c("job_id").alias("id"), "result")
    rows = v.jobs.where("queue = 'q2'").join(F.broadcast(policy), "queue").join(results, "id", "left")
    return rows.select("id", "stored_state", "paused", "result")


@query("s12_projections", """SELECT d.dependency_id AS id, coalesce(j.stored_state, CASE WHEN c.job_id IS NOT NULL THEN 'completed' END,
    'unknown') AS state, j.id IS NOT NULL AS has_row FROM (SELECT DISTINCT lpad(CAST(l_partkey * 13 AS VARCHAR), 12, '0') AS dependency_id
    FROM lineitem) d LEFT JOIN (SELECT * FROM jobs WHERE stored_state <> 'completed') j ON j.id = d.dependency_id
    LEFT JOIN completions c ON c.job_id = d.dependency_id""")  # fmt: skip
def _(v):
    wanted = v.table("lineitem").select(F.lpad((c("l_partkey") * 13).cast("string"), 12, "0").alias("id")).distinct()
    return J.projections(wanted, v.jobs.where("stored_state <> 'completed'"), v.completions)


@query("s16_batch_upsert", """SELECT job_id, completed_at, result FROM (SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY completed_at DESC, fresh DESC) AS n FROM (SELECT job_id, completed_at, result, 0 AS fresh FROM completions UNION ALL
    SELECT id, run_at + 86400000, price + 1, 1 FROM jobs WHERE queue = 'q3')) WHERE n = 1""")  # fmt: skip
def _(v):
    stored = v.completions.select("job_id", "completed_at", "result")
    new = v.jobs.where("queue = 'q3'").select(c("id").alias("job_id"), (c("run_at") + DAY).alias("completed_at"), (c("price") + 1).alias("result"))
    return M.latest_wins(stored, new, ["job_id"], "completed_at")


@query("s18_journal", """SELECT tx, id FROM log WHERE (tx, id) > (40, 500)""")
def _(v):
    later = (c("tx") > 40) | ((c("tx") == 40) & (c("id") > 500))
    return v.events.where(later).select("tx", "id")


@query("o2_claim", f"SELECT id FROM live WHERE group_id IS NULL AND queue = 'q1' ORDER BY {READY_SQL} LIMIT 50")
def _(v):
    blocked = J.unmet(v.dependencies, v.completions)
    alone = v.jobs.where("group_id is null and queue = 'q1'")
    return O.claimable(alone, blocked, NOW).orderBy(*O.ready_order()).limit(50).select("id")


GROUPED_SQL = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority, run_at, group_order, id) AS group_position
    FROM live WHERE group_id IS NOT NULL AND queue = 'q2'), active AS (SELECT group_id, count(*) AS n FROM jobs
    WHERE stored_state = 'active' AND queue = 'q2' AND group_id IS NOT NULL GROUP BY group_id),
room AS (SELECT g.group_id, last_served, least(60, greatest(0, coalesce(concurrency_limit, 1000) - coalesce(n, 0)),
    greatest(0, coalesce(rate_limit, 20) - rate_count)) AS available FROM groups g LEFT JOIN active USING (group_id) WHERE NOT paused)
SELECT id, group_id, group_position FROM ranked JOIN room USING (group_id) WHERE group_position <= available
ORDER BY group_position, last_served NULLS FIRST, group_id LIMIT 60"""


@query("o3_claim_grouped", GROUPED_SQL)
def _(v):
    own = v.jobs.where("queue = 'q2'")
    blocked = J.unmet(v.dependencies, v.completions)
    return J.claim_grouped(own, blocked, v.groups, NOW, 60, 1000, 20).select("id", "group_id", "group_position")


@query("o4_claim_all", f""", alone AS (SELECT id, 0 AS source FROM live WHERE group_id IS NULL AND queue = 'q4' ORDER BY {READY_SQL} LIMIT 200),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority, run_at, group_order, id) AS group_position
    FROM live WHERE group_id IS NOT NULL AND queue = 'q4'),
grouped AS (SELECT id, row_number() OVER (ORDER BY group_position, last_served NULLS FIRST, group_id) AS n
    FROM ranked JOIN groups USING (group_id) WHERE NOT paused)
SELECT id, source FROM alone UNION ALL SELECT id, 1 FROM grouped WHERE n <= 200 - (SELECT count(*) FROM alone)""")  # fmt: skip
def _(v):
    blocked = J.unmet(v.dependencies, v.completions)
    return M.pull(v.jobs.where("queue = 'q4'"), blocked, v.groups, NOW, 200)


@query("o6_job_page", f"""SELECT id, created_at FROM jobs WHERE stored_state = 'pending' AND run_at <= {NOW}
    ORDER BY created_at DESC, id DESC LIMIT 80 OFFSET 20""")  # fmt: skip
def _(v):
    return O.list_jobs(v.jobs, ["waiting", "prioritized"], NOW, 20, 100, asc=False).select("id", "created_at")


@query("o7_overlay_page", """SELECT id, priority FROM (SELECT id, created_at, priority FROM jobs WHERE queue <> 'q5' UNION ALL
    SELECT id, created_at, 99 FROM jobs WHERE queue = 'q5') ORDER BY created_at, id LIMIT 100""")  # fmt: skip
def _(v):
    buffered = v.jobs.where("queue = 'q5'").withColumn("priority", F.lit(99))
    return O.page(O.overlay(v.jobs, buffered), 0, 100).select("id", "priority")


@query("o8_listing", "SELECT id, state FROM stated WHERE queue = 'q6' ORDER BY created_at, id LIMIT 100")
def _(v):
    first = O.page(v.jobs.where("queue = 'q6'"), 0, 100)
    return with_state(first, v.dead, NOW).select("id", "state")


@query("o9_keyset_page", f"""SELECT id, coalesce(completed_at, created_at) AS sort_time FROM jobs WHERE stored_state = 'completed'
    AND (coalesce(completed_at, created_at), id) > ({NOW - 500 * DAY}, '000000000100')
    ORDER BY coalesce(completed_at, created_at), id LIMIT 100""")  # fmt: skip
def _(v):
    done = v.jobs.where("stored_state = 'completed'")
    return O.after_key(done, NOW - 500 * DAY, "000000000100", 100, F.coalesce("completed_at", "created_at")).select("id", "sort_time")


@query("o11_overflow", """SELECT id FROM (SELECT id FROM jobs WHERE stored_state = 'completed' ORDER BY completed_at DESC, id DESC
    OFFSET 500)""")  # fmt: skip
def _(v):
    return O.overflow(v.jobs.where("stored_state = 'completed'"), "completed_at", 500).select("id")


@query("o12_oldest", f"SELECT id, created_at FROM jobs WHERE created_at <= {NOW - 30 * DAY} ORDER BY created_at, id LIMIT 100")
def _(v):
    return O.oldest_before(v.jobs, NOW - 30 * DAY, 100).select("id", "created_at")


@query("j1_ready", "SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM blocked)")
def _(v):
    return J.ready(v.jobs, v.dependencies, v.completions).select("id")


@query("j2_consumers", """SELECT DISTINCT j.id FROM jobs j JOIN dependencies d ON d.job_id = j.id
    JOIN jobs f ON f.id = d.dependency_id WHERE j.stored_state = 'pending' AND f.queue = 'q1'""")  # fmt: skip
def _(v):
    return J.consumers(v.jobs, v.dependencies, v.jobs.where("queue = 'q1'").select("id")).select("id")


@query("j3_group_policy", "SELECT j.id, coalesce(g.paused, FALSE) AS group_paused FROM jobs j LEFT JOIN groups g USING (group_id)")
def _(v):
    return J.with_group_policy(v.jobs, F.broadcast(v.groups)).select("id", "group_paused")


@query("j4_missing", """SELECT DISTINCT lpad(CAST(l_partkey * 13 AS VARCHAR), 12, '0') AS id FROM lineitem
    WHERE lpad(CAST(l_partkey * 13 AS VARCHAR), 12, '0') NOT IN (SELECT id FROM jobs)""")  # fmt: skip
def _(v):
    wanted = v.table("lineitem").select(F.lpad((c("l_partkey") * 13).cast("string"), 12, "0").alias("id")).distinct()
    return J.missing(wanted, v.jobs, v.completions)


@query("j9_groups_without_jobs", "SELECT group_id FROM groups WHERE group_id NOT IN (SELECT group_id FROM jobs WHERE stored_state <> 'completed' AND group_id IS NOT NULL)")
def _(v):
    return J.outside_groups(v.groups, v.jobs).select("group_id")


@query("j10_groups_with_pending", "SELECT group_id FROM groups WHERE group_id IN (SELECT group_id FROM jobs WHERE stored_state = 'pending')")
def _(v):
    return J.groups_with_pending(v.groups, v.jobs).select("group_id")


@query("j8_empty_commits", """SELECT DISTINCT tx FROM log WHERE tx NOT IN (SELECT tx FROM log WHERE event_type = 'failed' AND value > 95)
    AND tx NOT IN (SELECT tx FROM log WHERE event_type = 'pushed' AND value > 95)""")  # fmt: skip
def _(v):
    some = v.events.where("value > 95")
    commits = v.events.select("tx").distinct()
    return commits.join(some.where("event_type = 'failed'"), "tx", "left_anti").join(some.where("event_type = 'pushed'"), "tx", "left_anti")


@query("j11_queue_deletion", """SELECT id FROM jobs WHERE queue = 'q3' AND id NOT IN (SELECT job_id FROM dlq WHERE queue <> 'q3')""")
def _(v):
    others = v.dlq.where("queue <> 'q3'").select(c("job_id").alias("id"))
    return v.jobs.where("queue = 'q3'").join(others, "id", "left_anti").select("id")


@query("j12_children_values", """SELECT d.job_id AS parent_id, c.queue || ':' || d.dependency_id AS child_key, c.result
    FROM dependencies d JOIN completions c ON c.job_id = d.dependency_id""")  # fmt: skip
def _(v):
    return J.children_values(v.dependencies, v.completions)


@query("j16_fan_in", """SELECT DISTINCT d.job_id FROM dependencies d WHERE d.job_id NOT IN (SELECT job_id FROM dependencies
    WHERE dependency_id NOT IN (SELECT job_id FROM completions UNION SELECT id FROM jobs WHERE stored_state = 'active'))""")  # fmt: skip
def _(v):
    now_done = v.jobs.where("stored_state = 'active'").select(c("id").alias("job_id"))
    done = v.completions.select("job_id").union(now_done).distinct()
    return v.dependencies.select("job_id").distinct().join(J.unmet(v.dependencies, done), "job_id", "left_anti")


@query("j18_dependencies_by_state", """SELECT d.job_id AS parent_id, count(c.job_id) AS processed,
    count(*) - count(c.job_id) AS unprocessed FROM dependencies d LEFT JOIN completions c ON c.job_id = d.dependency_id GROUP BY 1""")  # fmt: skip
def _(v):
    return J.dependencies_by_state(v.dependencies, v.completions)


@query("j19_pinned_and_recent", """, needed AS (SELECT DISTINCT dependency_id AS job_id FROM dependencies d JOIN jobs j ON j.id = d.job_id
    WHERE j.stored_state <> 'completed')
SELECT job_id, TRUE AS pinned FROM completions WHERE job_id IN (SELECT job_id FROM needed) UNION ALL
SELECT job_id, FALSE FROM (SELECT job_id FROM completions WHERE job_id NOT IN (SELECT job_id FROM needed)
    ORDER BY completed_at DESC, job_id DESC LIMIT 100)""")  # fmt: skip
def _(v):
    live = v.jobs.where("stored_state <> 'completed'")
    return J.pinned_and_recent(v.completions, v.dependencies, live, 100).select("job_id", "pinned")


@query("j21_dlq_policy", "SELECT d.queue, q.max_auto_retries, count(*) AS n FROM dlq d JOIN queue_state q USING (queue) GROUP BY 1, 2")
def _(v):
    joined = v.dlq.join(F.broadcast(v.queue_state), "queue")
    return joined.groupBy("queue", "max_auto_retries").agg(F.count("*").alias("n"))


@query("j22_leases", "SELECT id FROM jobs WHERE stored_state = 'active' AND attempts = 1 AND queue IN ('q1', 'q2')")
def _(v):
    wanted = v.jobs.where("queue in ('q1', 'q2')").select("id", F.lit(1).alias("attempts"))
    return J.by_request(v.jobs.where("stored_state = 'active'"), wanted, ["id", "attempts"]).select("id")


@query("u1_queue_names", "SELECT queue FROM jobs UNION SELECT queue FROM queue_state")
def _(v):
    return v.jobs.select("queue").union(v.queue_state.select("queue")).distinct()


@query("u2_done_ids", "SELECT job_id FROM completions UNION SELECT id FROM jobs WHERE stored_state = 'active'")
def _(v):
    return v.completions.select("job_id").union(v.jobs.where("stored_state = 'active'").select("id")).distinct()


@query("u6_excluding", "SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM dead)")
def _(v):
    return v.jobs.select("id").join(v.dead.select(c("job_id").alias("id")), "id", "left_anti")


@query("x2_server_backoff", """SELECT id, least(CASE WHEN attempts = 0 THEN 1000.0 ELSE 1000 * pow(2.0, attempts) END, 3600000.0) AS delay_ms
    FROM jobs""")  # fmt: skip
def _(v):
    kind = F.when(c("attempts") == 0, "fixed").otherwise("exponential")
    return v.jobs.select("id", X.server_backoff(kind, F.lit(1000), c("attempts")).alias("delay_ms"))


@query("x3_client_backoff", """SELECT id, CASE name WHEN 'n0' THEN 100.0 WHEN 'n1' THEN 100 * pow(2.0, attempts)
    WHEN 'n2' THEN floor(100 * pow(2.0, attempts) * 0.75) ELSE 100 * [1, 2, 3, 5][attempts + 1]::DOUBLE END AS delay_ms FROM jobs""")  # fmt: skip
def _(v):
    strategy = F.when(c("name") == "n0", "fixed").when(c("name") == "n1", "exponential").when(c("name") == "n2", "jitter").otherwise("fibonacci")
    return v.jobs.select("id", X.client_backoff(strategy, c("attempts") + 1, F.lit(100), 0.75).alias("delay_ms"))


@query("x4_dlq_next_retry", f"""SELECT entry_id, CASE WHEN retry_count + 1 < 3 THEN CAST({NOW} + 60000 * pow(2.0, retry_count) AS BIGINT) END
    AS next_retry FROM dlq""")  # fmt: skip
def _(v):
    return v.dlq.select("entry_id", X.dlq_next_retry(NOW, 60000, c("retry_count"), F.lit(3)).alias("next_retry"))


@query("x5_interval_next_run", f"""SELECT id, CASE WHEN run_at + 3600000 < {NOW} + 1
    THEN run_at + 3600000 + CAST(ceil(({NOW} + 1 - run_at - 3600000) / 3600000.0) AS BIGINT) * 3600000 ELSE run_at + 3600000 END AS next_run
    FROM jobs""")  # fmt: skip
def _(v):
    none = F.lit(None).cast("bigint")
    return v.jobs.select("id", X.next_interval_run(c("run_at"), F.lit(3600000).cast("bigint"), NOW, none, none).alias("next_run"))


@query("x13_aging", f"""SELECT id, CASE WHEN {NOW} - created_at >= {300 * DAY} AND priority < 3 THEN least(priority + 2, 3) ELSE priority END
    AS priority FROM jobs WHERE stored_state = 'pending'""")  # fmt: skip
def _(v):
    return v.jobs.where("stored_state = 'pending'").select("id", X.aged_priority(NOW, 300 * DAY, 2, 3).alias("priority"))


@query("m5_complete", f"""SELECT id, CASE WHEN stored_state = 'active' AND queue = 'q1' THEN 'completed' ELSE stored_state END AS stored_state,
    CASE WHEN stored_state = 'active' AND queue = 'q1' THEN {NOW} ELSE completed_at END AS completed_at FROM jobs""")  # fmt: skip
def _(v):
    acks = v.jobs.where("queue = 'q1'").select("id", c("price").alias("result"))
    return M.complete(v.jobs, acks, NOW)[0].select("id", "stored_state", "completed_at")


@query("m7_fail", f"""SELECT id, CASE WHEN attempts + 1 < max_attempts AND priority <> 4 THEN 'retry' WHEN lifo THEN 'remove' ELSE 'dlq' END AS fate,
    CASE WHEN attempts + 1 < max_attempts AND priority <> 4 THEN {NOW} + CAST(least(1000 * pow(2.0, attempts + 1), 3600000) AS BIGINT)
    ELSE run_at END AS run_at FROM jobs WHERE stored_state = 'active'""")  # fmt: skip
def _(v):
    failures = v.jobs.select("id", (c("priority") == 4).alias("unrecoverable"), c("lifo").alias("remove"))
    out = M.fail(v.jobs, failures, NOW)
    rows = [out[k].select("id", F.lit(k).alias("fate"), "run_at") for k in ("retry", "remove", "dlq")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("m8_cancel", "SELECT id FROM jobs WHERE NOT (queue = 'q7' AND stored_state = 'pending')")
def _(v):
    return M.cancel(v.jobs, v.jobs.where("queue = 'q7'").select("id")).select("id")


@query("m9_progress", """SELECT id, CASE WHEN stored_state = 'active' THEN greatest(0, least(100, progress * 2 - 20)) ELSE progress END AS progress
    FROM jobs""")  # fmt: skip
def _(v):
    return M.update_progress(v.jobs, v.jobs.select("id", (c("progress") * 2 - 20).alias("progress"))).select("id", "progress")


@query("m11_promote", f"""SELECT id, CASE WHEN id IN (SELECT id FROM jobs WHERE stored_state = 'pending' AND run_at > {NOW}
    ORDER BY created_at, id LIMIT 25) THEN {NOW} ELSE run_at END AS run_at FROM jobs""")  # fmt: skip
def _(v):
    return M.promote(v.jobs, NOW, 25).select("id", "run_at")


@query("m13_delay", f"""SELECT id, CASE WHEN queue = 'q1' AND stored_state = 'active' THEN 'pending' ELSE stored_state END AS stored_state,
    CASE WHEN queue = 'q1' AND stored_state = 'active' THEN {NOW + 5000} ELSE run_at END AS run_at FROM jobs""")  # fmt: skip
def _(v):
    return M.delay(v.jobs, v.jobs.where("queue = 'q1'").select("id"), NOW, 5000, active=True).select("id", "stored_state", "run_at")


@query("m17_drain", "SELECT id FROM jobs WHERE NOT (queue = 'q1' AND stored_state = 'pending')")
def _(v):
    return M.drain(v.jobs, "q1").select("id")


@query("m19_clean", f"""SELECT id FROM jobs WHERE stored_state = 'pending' AND created_at <= {NOW - DAY} ORDER BY created_at, id LIMIT 1000""")
def _(v):
    return M.clean(v.jobs, NOW, DAY, "delayed")


@query("m20_retry_dlq", """SELECT entry_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY entered_at, entry_id) AS n
    FROM (SELECT * FROM dlq ORDER BY entered_at, entry_id LIMIT 500)) WHERE n = 1""")  # fmt: skip
def _(v):
    return M.retry_dlq(v.dlq, 500).select("entry_id", "job_id")


@query("m25_flow_failures", """, failures AS (SELECT job_id AS parent_id, dependency_id AS child_id,
    ['fail', 'remove', 'ignore', 'continue'][CAST(substr(dependency_id, 12, 1) AS INTEGER) % 4 + 1] AS mode FROM dependencies
    WHERE CAST(substr(dependency_id, 12, 1) AS INTEGER) % 2 = 1 OR CAST(substr(job_id, 12, 1) AS INTEGER) = 4),
modes AS (SELECT parent_id, bool_or(mode = 'fail') AS fails, bool_or(mode = 'continue') AS goes_on FROM failures GROUP BY 1),
open_edges AS (SELECT DISTINCT d.job_id FROM dependencies d WHERE (d.job_id, d.dependency_id) NOT IN (SELECT (parent_id, child_id) FROM failures)
    AND d.dependency_id NOT IN (SELECT job_id FROM completions))
SELECT j.id, CASE WHEN fails THEN 'fail' WHEN goes_on OR o.job_id IS NULL THEN 'ready' ELSE 'wait' END AS outcome
FROM jobs j JOIN modes m ON m.parent_id = j.id LEFT JOIN open_edges o ON o.job_id = j.id WHERE j.stored_state = 'pending'""")  # fmt: skip
def _(v):
    digit = F.substring("dependency_id", 12, 1).cast("int")
    names = F.array(*[F.lit(m) for m in ("fail", "remove", "ignore", "continue")])
    failed = v.dependencies.where((digit % 2 == 1) | (F.substring("job_id", 12, 1) == "4"))
    failures = failed.select(c("job_id").alias("parent_id"), c("dependency_id").alias("child_id"), F.get(names, digit % 4).alias("mode"))
    return M.resolve_flow_failures(v.jobs, v.dependencies, failures, v.completions)


@query("m27_expire", f"""SELECT id FROM jobs WHERE stored_state = 'pending' AND ttl IS NOT NULL AND {NOW} > created_at + ttl
    ORDER BY created_at, id LIMIT 1000""")  # fmt: skip
def _(v):
    return M.expire(v.jobs, NOW)


@query("m28_recover", f"""SELECT id, queue, CASE WHEN attempts + 1 < max_attempts THEN 'retry' ELSE 'dlq' END AS "to" FROM jobs
    WHERE stored_state = 'active' AND heartbeat_at + {30 * DAY} <= {NOW}""")  # fmt: skip
def _(v):
    return M.recover(v.jobs, NOW, 30 * DAY)
