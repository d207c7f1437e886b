"""Queries over counts, events, series, windows and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators import aggregates as A
from jobloom.operators import graph as G
from jobloom.plans.registry import query
from jobloom.sources.tables import DAY, NOW, REASONS

c = F.col
COUNTS = ", ".join(f"count(*) FILTER (state = '{s.replace('_', '-')}') AS {s}" for s in A.STATES)
BUCKETS = """buckets AS (SELECT queue, event_type, occurred_at // 60000 AS minute, count(*) AS n FROM log
    WHERE event_type = 'completed' OR (event_type = 'failed' AND terminal) GROUP BY ALL)"""


@query("a1_state_counts", f"""SELECT q.queue, {", ".join(f"coalesce({s}, 0) AS {s}" for s in A.STATES)} FROM queue_state q
    LEFT JOIN (SELECT queue, {COUNTS} FROM stated GROUP BY queue) USING (queue)""")  # fmt: skip
def _(v):
    return A.state_counts(A.with_state(v.jobs, v.dead, NOW), v.queue_state)


@query("a2_global_counts", f"SELECT {COUNTS}, count(*) AS total FROM stated")
def _(v):
    sums = [F.count_if(c("state") == s.replace("_", "-")).alias(s) for s in A.STATES]
    return A.with_state(v.jobs, v.dead, NOW).agg(*sums, F.count("*").alias("total"))


@query("a3_stored_counts", "SELECT stored_state, count(*) AS n FROM jobs GROUP BY 1")
def _(v):
    return v.jobs.groupBy("stored_state").agg(F.count("*").alias("n"))


@query("a4_counts_by_queue", "SELECT queue, stored_state, count(*) AS n FROM jobs GROUP BY 1, 2")
def _(v):
    return v.jobs.groupBy("queue", "stored_state").agg(F.count("*").alias("n"))


@query("a5_counts_by_priority", "SELECT priority, count(*) AS n FROM jobs WHERE stored_state = 'pending' GROUP BY 1")
def _(v):
    return v.jobs.where("stored_state = 'pending'").groupBy("priority").agg(F.count("*").alias("n"))


@query("a6_queue_depth", "SELECT queue, count(*) AS n FROM jobs WHERE stored_state = 'pending' GROUP BY 1")
def _(v):
    return v.jobs.where("stored_state = 'pending'").groupBy("queue").agg(F.count("*").alias("n"))


@query("a7_queue_summary", f"""SELECT queue, paused AS is_paused, CASE WHEN paused THEN 0 ELSE coalesce(waiting, 0) END AS waiting,
    CASE WHEN paused THEN 0 ELSE coalesce(prioritized, 0) END AS prioritized,
    CASE WHEN paused THEN coalesce(waiting, 0) + coalesce(prioritized, 0) ELSE 0 END AS paused,
    coalesce(delayed, 0) AS delayed, coalesce(active, 0) AS active, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed
    FROM queue_state LEFT JOIN (SELECT queue, {COUNTS} FROM stated GROUP BY queue) USING (queue)""")  # fmt: skip
def _(v):
    return A.queue_summary(v.jobs, v.dead, v.queue_state, NOW)


@query("a9_dlq_stats", f"""SELECT queue, count(*) AS total, {", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in REASONS)},
    count(*) FILTER (next_retry_at <= {NOW} AND retry_count < max_auto_retries) AS pending_retry,
    count(*) FILTER (expires_at <= {NOW}) AS expired, min(entered_at) AS oldest_entry, max(entered_at) AS newest_entry
    FROM dlq JOIN queue_state USING (queue) GROUP BY queue""")  # fmt: skip
def _(v):
    return A.dlq_stats(v.dlq, F.broadcast(v.queue_state), NOW)


@query("a10_minute_buckets", f", {BUCKETS} SELECT * FROM buckets")
def _(v):
    return A.minute_buckets(v.events)


@query("a11_merged_buckets", f", {BUCKETS} SELECT queue, event_type, minute, CAST(n + 1 AS BIGINT) AS n FROM buckets")
def _(v):
    stored = A.minute_buckets(v.events)
    return A.merge_buckets(stored, stored.withColumn("n", F.lit(1).cast("bigint")))


@query("a12_totals", f", {BUCKETS} SELECT queue, event_type, CAST(sum(n) AS BIGINT) AS total, max(minute) AS prev_minute, arg_max(n, minute) AS prev_n FROM buckets GROUP BY 1, 2")
def _(v):
    return A.totals(A.minute_buckets(v.events))


SERIES = f""", {BUCKETS}, span AS (SELECT queue, event_type, max(minute) AS newest, min(minute) AS oldest FROM buckets GROUP BY 1, 2),
minutes AS (SELECT queue, event_type, newest, unnest(generate_series(greatest(oldest, newest - 1439), newest)) AS minute FROM span),
series AS (SELECT m.queue, m.event_type, m.minute, newest - m.minute AS position, coalesce(n, 0) AS n FROM minutes m
    LEFT JOIN buckets USING (queue, event_type, minute))"""


@query("a13_dense_series", f"{SERIES} SELECT * FROM series")
def _(v):
    return A.dense_series(A.minute_buckets(v.events), 1440)


@query("o13_series_page", f"{SERIES} SELECT * FROM series WHERE position BETWEEN 10 AND 29")
def _(v):
    return A.series_page(A.dense_series(A.minute_buckets(v.events), 1440), 10, 29)


@query("t2_retained_buckets", f", {BUCKETS} SELECT queue, event_type, minute, n FROM (SELECT *, max(minute) OVER (PARTITION BY queue, event_type) AS last FROM buckets) WHERE minute > last - 2000")
def _(v):
    return A.retained(A.minute_buckets(v.events), 2000)


CELLS = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(A.BOUNDS))


@query("a14_histogram", f"SELECT queue, {CELLS}, count(value) AS n FROM log GROUP BY queue")
def _(v):
    return A.histogram(v.events, "queue", "value").drop("total")


@query("a15_percentiles", f""", h AS (SELECT queue, {CELLS}, count(value) AS n FROM log GROUP BY queue)
SELECT queue, {", ".join(f"CASE {' '.join(f'WHEN le_{i} >= n * ({p} / 100.0) THEN {float(b)}' for i, b in enumerate(A.BOUNDS))} ELSE {float(A.BOUNDS[-1])} END::DOUBLE AS p{p}" for p in (50, 95, 99))}
FROM h""")  # fmt: skip
def _(v):
    h = A.histogram(v.events, "queue", "value")
    return h.select("queue", *[A.bucket_percentile(p).alias(f"p{p}") for p in (50, 95, 99)])


@query("a16_average", "SELECT q.queue, round(coalesce(avg(value), 0), 6) AS mean FROM queue_state q LEFT JOIN log USING (queue) GROUP BY q.queue")
def _(v):
    means = v.events.groupBy("queue").agg(F.avg("value").alias("mean"))
    return v.queue_state.select("queue").join(means, "queue", "left").select("queue", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


@query("a17_smoothed_rate")
def _(v):
    return A.smoothed_rate(A.minute_buckets(v.events).withColumn("at", c("minute") * 60000), "queue", "at", "n")


@query("a18_distinct_done", "SELECT count(*) AS n FROM (SELECT job_id FROM completions UNION SELECT id FROM jobs WHERE stored_state = 'active')")
def _(v):
    return v.completions.select("job_id").union(v.jobs.where("stored_state = 'active'").select("id")).distinct().agg(F.count("*").alias("n"))


@query("a19_active_groups", "SELECT group_id, count(*) AS n FROM jobs WHERE stored_state = 'active' AND group_id IS NOT NULL GROUP BY 1")
def _(v):
    return v.jobs.where("stored_state = 'active' and group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))


@query("w2_first_orders", """SELECT group_id, first_order, row_number() OVER (ORDER BY first_order, group_id) AS position
    FROM (SELECT group_id, min(group_order) AS first_order FROM jobs WHERE group_id IS NOT NULL GROUP BY 1)""")  # fmt: skip
def _(v):
    # One row a group: the ranking without partitions is over the aggregate.
    first = v.jobs.where("group_id is not null").groupBy("group_id").agg(F.min("group_order").alias("first_order"))
    rank = F.row_number().over(Window.orderBy("first_order", "group_id"))
    return first.withColumn("position", rank.cast("bigint"))


@query("a21_overfull_queues", "SELECT queue, count(*) AS n FROM log GROUP BY 1 HAVING count(*) > 1000")
def _(v):
    return v.events.groupBy("queue").agg(F.count("*").alias("n")).where("n > 1000")


@query("a22_cursors", "SELECT max(id) AS last_id, max(tx) AS last_tx FROM log")
def _(v):
    return v.events.agg(F.max("id").alias("last_id"), F.max("tx").alias("last_tx"))


@query("a23_completed_counts", "SELECT queue, count(*) AS n FROM completions GROUP BY 1")
def _(v):
    return v.completions.groupBy("queue").agg(F.count("*").alias("n"))


@query("a25_group_depth", "SELECT group_id, count(*) AS depth FROM jobs WHERE stored_state = 'pending' AND group_id IS NOT NULL GROUP BY 1")
def _(v):
    return v.jobs.where("stored_state = 'pending' and group_id is not null").groupBy("group_id").agg(F.count("*").alias("depth"))


@query("a26_worker_stats", f"""SELECT count(*) AS total, count(*) FILTER ({NOW} - seen < {90 * DAY}) AS active,
    coalesce(CAST(sum(CASE WHEN {NOW} - seen < {90 * DAY} THEN slots END) AS BIGINT), 0) AS slots
    FROM (SELECT o_custkey, max(epoch_ms(o_orderdate)) AS seen, count(*) AS slots FROM orders
    WHERE epoch_ms(o_orderdate) <= {NOW} GROUP BY 1)""")  # fmt: skip
def _(v):
    from jobloom.sources.tables import millis

    seen = v.table("orders").select("o_custkey", millis(c("o_orderdate")).alias("at")).where(c("at") <= NOW)
    workers = seen.groupBy("o_custkey").agg(F.max("at").alias("seen"), F.count("*").alias("slots"))
    live = NOW - c("seen") < 90 * DAY
    slots = F.coalesce(F.sum(F.when(live, c("slots"))), F.lit(0))
    return workers.agg(F.count("*").alias("total"), F.count_if(live).alias("active"), slots.alias("slots"))


@query("a28_flows_done", """SELECT d.job_id AS parent_id, bool_and(c.job_id IS NOT NULL) AS done FROM dependencies d
    LEFT JOIN completions c ON c.job_id = d.dependency_id GROUP BY 1""")  # fmt: skip
def _(v):
    done = v.completions.select(c("job_id").alias("dependency_id"), F.lit(True).alias("is_done"))
    flows = v.dependencies.join(done, "dependency_id", "left").groupBy(c("job_id").alias("parent_id"))
    return flows.agg(F.bool_and(c("is_done").isNotNull()).alias("done"))


@query("w3_newest_per_state", """SELECT id, queue, stored_state FROM (SELECT *, row_number() OVER (PARTITION BY queue, stored_state
    ORDER BY created_at, id) AS n FROM jobs) WHERE n <= 100""")  # fmt: skip
def _(v):
    return A.keep_newest(v.jobs, ["queue", "stored_state"], [c("created_at"), c("id")], 100).select("id", "queue", "stored_state")


@query("w5_last_event", """SELECT queue, id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY occurred_at DESC, id DESC) AS n
    FROM log) WHERE n = 1""")  # fmt: skip
def _(v):
    last = v.events.groupBy("queue").agg(F.max(F.struct("occurred_at", "id")).alias("last"))
    return last.select("queue", "last.id")


@query("w6_share_of_newest", "SELECT id, queue, max(created_at) OVER (PARTITION BY queue) - created_at AS behind FROM jobs")
def _(v):
    newest = v.jobs.groupBy("queue").agg(F.max("created_at").alias("newest"))
    return v.jobs.join(newest, "queue").select("id", "queue", (c("newest") - c("created_at")).alias("behind"))


@query("t3_event_cap", """SELECT id, queue FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY id DESC) AS n FROM log)
    WHERE n <= 500""")  # fmt: skip
def _(v):
    return A.keep_newest(v.events, ["queue"], [c("id").desc()], 500).select("id", "queue")


@query("t25_failure_ratio", """, m AS (SELECT queue, occurred_at // 300000 AS slot, count(*) FILTER (event_type = 'failed') AS bad,
    count(*) AS n FROM log WHERE event_type IN ('failed', 'completed') GROUP BY ALL)
SELECT queue, slot, bad / n AS ratio FROM m WHERE bad / n > 0.5""")  # fmt: skip
def _(v):
    slot = F.expr("occurred_at div 300000").alias("slot")
    ends = v.events.where("event_type in ('failed', 'completed')").groupBy("queue", slot)
    m = ends.agg(F.count_if(c("event_type") == "failed").alias("bad"), F.count("*").alias("n"))
    return m.select("queue", "slot", (c("bad") / c("n")).alias("ratio")).where("ratio > 0.5")


def _arrows(v, name="cyclic"):
    return getattr(v, name).select(c("job_id").alias("src"), c("dependency_id").alias("dst"))


REACH = """, walk(start, node) AS (SELECT job_id, dependency_id FROM cyclic
    UNION SELECT w.start, c.dependency_id FROM walk w JOIN cyclic c ON c.job_id = w.node) """


@query("j13_reachable", REACH + "SELECT start, node FROM walk")
def _(v):
    return G.reachable(_arrows(v), v.jobs.select(c("id").alias("node")))


@query("j13_cycles", """, walk(start, node) AS (SELECT job_id, dependency_id FROM cyclic
    UNION SELECT w.start, c.dependency_id FROM walk w JOIN cyclic c ON c.job_id = w.node) SELECT start AS node FROM walk WHERE start = node""")  # fmt: skip
def _(v):
    return G.on_cycles(_arrows(v))


@query("j14_asymmetric", """SELECT job_id AS src, dependency_id AS dst, 'parent' AS side FROM cyclic WHERE job_id <= dependency_id""")
def _(v):
    return G.asymmetric(_arrows(v), _arrows(v, "dependencies"))


@query("j14_levels", """, depth(node, level) AS (SELECT job_id, 0 FROM dependencies WHERE job_id NOT IN (SELECT dependency_id FROM dependencies)
    UNION SELECT d.dependency_id, level + 1 FROM depth JOIN dependencies d ON d.job_id = node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM depth GROUP BY node""")  # fmt: skip
def _(v):
    return G.peel(_arrows(v, "dependencies"))[0]


@query("j15_tree", """, narrow AS (SELECT job_id, dependency_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY dependency_id) AS n
    FROM cyclic) WHERE n <= 2),
walk(root, node, depth, path) AS (SELECT id, id, 0, [id] FROM jobs UNION ALL
    SELECT root, n.dependency_id, depth + 1, list_append(path, n.dependency_id) FROM walk JOIN narrow n ON n.job_id = node
    WHERE depth < 4 AND NOT list_contains(path, n.dependency_id)) SELECT root, node, depth FROM walk""")  # fmt: skip
def _(v):
    return G.tree(_arrows(v), v.jobs.select(c("id").alias("node")), 4, 2)


@query("j17_removable", """, child AS (SELECT id FROM jobs WHERE stored_state = 'pending'),
need(id) AS (SELECT dependency_id FROM dependencies WHERE job_id NOT IN (SELECT id FROM child) AND dependency_id IN (SELECT id FROM child)
    UNION SELECT d.dependency_id FROM need n JOIN dependencies d ON d.job_id = n.id WHERE d.dependency_id IN (SELECT id FROM child))
SELECT id FROM child WHERE id NOT IN (SELECT id FROM need)""")  # fmt: skip
def _(v):
    return G.removable(v.jobs.where("stored_state = 'pending'").select("id"), v.dependencies)


@query("g2_chain", """SELECT lag(id) OVER w AS src, id AS dst FROM chain WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    QUALIFY src IS NOT NULL""")  # fmt: skip
def _(v):
    return G.chain_edges(v.chain, "conv_id", "turn", "id")


@query("g3_fan_in", "SELECT id AS src, 'final' AS dst FROM chain WHERE turn = 0")
def _(v):
    return G.fan_in_edges(v.chain.where("turn = 0").select(c("id").alias("node")), "final")


@query("g5_parent_results", """SELECT d.job_id AS child_id, p.id AS parent_id, c.result FROM dependencies d JOIN jobs p ON p.id = d.dependency_id
    LEFT JOIN completions c ON c.job_id = p.id""")  # fmt: skip
def _(v):
    done = v.completions.select(c("job_id").alias("parent_id"), "result")
    return v.dependencies.select(c("job_id").alias("child_id"), c("dependency_id").alias("parent_id")).join(done, "parent_id", "left")
