"""Further queries: transitions, retention, journals and small helpers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import predicates as P
from jobloom.functions import scalars as X
from jobloom.operators import aggregates as A
from jobloom.operators import graph as G
from jobloom.operators import joins as J
from jobloom.operators import lifecycle as M
from jobloom.operators import ordering as O
from jobloom.operators.ranking import numbered
from jobloom.plans.registry import query
from jobloom.sources.tables import DAY, NOW

c = F.col


@query("f7_collected", "SELECT id, state FROM stated WHERE queue = 'q4' AND state IN ('waiting', 'active', 'failed')")
def _(v):
    own = v.jobs.where("queue = 'q4'")
    return A.with_state(own, v.dead, NOW).where("state in ('waiting', 'active', 'failed')").select("id", "state")


@query("f10_dlq_expired", f"SELECT entry_id FROM dlq WHERE expires_at IS NOT NULL AND {NOW} >= expires_at")
def _(v):
    return v.dlq.where(P.is_dlq_expired(NOW)).select("entry_id")


@query("f13_expired_keys", f"SELECT id, unique_key FROM jobs WHERE created_at + {30 * DAY} <= {NOW}")
def _(v):
    keys = v.jobs.select("id", "unique_key", (c("created_at") + 30 * DAY).alias("expires_at"))
    return keys.where(P.is_key_expired(NOW)).select("id", "unique_key")


@query("f14_due_crons", f"SELECT name FROM crons WHERE next_run <= {NOW} AND (max_limit IS NULL OR executions < max_limit)")
def _(v):
    return v.crons.where(P.is_cron_due(NOW)).select("name")


@query("o15_cron_order", f"SELECT name, next_run FROM crons WHERE next_run <= {NOW} ORDER BY next_run, name LIMIT 100")
def _(v):
    return v.crons.where(c("next_run") <= NOW).orderBy("next_run", "name").limit(100).select("name", "next_run")


@query("f18_quarantine", "SELECT event_id FROM events WHERE try_cast(CASE WHEN event_id % 50 = 0 THEN '{' || props ELSE props END AS JSON) IS NULL")
def _(v):
    broken = F.when(c("event_id") % 50 == 0, F.concat(F.lit("{"), "props")).otherwise(c("props"))
    parsed = F.try_parse_json(broken)
    return v.table("events").where(parsed.isNull()).select("event_id")


@query("j5_group_capacity", """SELECT g.group_id, CAST(least(50, greatest(0, coalesce(concurrency_limit, 10) - coalesce(n, 0)),
    greatest(0, coalesce(rate_limit, 20) - rate_count)) AS BIGINT) AS available FROM groups g LEFT JOIN (SELECT group_id, count(*) AS n
    FROM jobs WHERE stored_state = 'active' GROUP BY 1) USING (group_id) WHERE NOT paused""")  # fmt: skip
def _(v):
    active = v.jobs.where("stored_state = 'active'").groupBy("group_id").agg(F.count("*").alias("n_active"))
    return J.group_capacity(v.groups, active, 50, 10, 20).select("group_id", "available")


@query("j7_journal_join", """SELECT l.id, l.tx, c.n FROM log l JOIN (SELECT tx, count(*) AS n FROM log GROUP BY 1) c USING (tx) WHERE tx > 0""")
def _(v):
    commits = v.events.groupBy("tx").agg(F.count("*").alias("n"))
    return J.journal(v.events, commits, c("tx") > 0).select("id", "tx", "n")


@query("u3_children", "SELECT job_id AS parent, dependency_id AS child FROM dependencies UNION SELECT dependency_id, job_id FROM cyclic")
def _(v):
    one = v.dependencies.select(c("job_id").alias("parent"), c("dependency_id").alias("child"))
    return one.union(v.cyclic.select("dependency_id", "job_id")).distinct()


@query("u4_live_and_kept", """SELECT id, TRUE AS live FROM jobs WHERE stored_state = 'active' UNION ALL
    SELECT id, FALSE FROM jobs WHERE stored_state = 'completed' AND queue = 'q1'""")  # fmt: skip
def _(v):
    live = v.jobs.where("stored_state = 'active'").select("id", F.lit(True).alias("live"))
    return live.unionByName(v.jobs.where("stored_state = 'completed' and queue = 'q1'").select("id", F.lit(False).alias("live")))


@query("u5_any_rows", "SELECT q.queue, EXISTS (SELECT 1 FROM jobs j WHERE j.queue = q.queue UNION ALL SELECT 1 FROM dlq d WHERE d.queue = q.queue) AS present FROM queue_state q")
def _(v):
    seen = v.jobs.select("queue").union(v.dlq.select("queue")).distinct().withColumn("seen", F.lit(True))
    return v.queue_state.select("queue").join(seen, "queue", "left").select("queue", c("seen").isNotNull().alias("present"))


@query("u7_distinct_queues", "SELECT DISTINCT queue FROM log")
def _(v):
    return v.events.select("queue").distinct()


@query("o14_conversations", """SELECT conv_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    ORDER BY n DESC, conv_id DESC LIMIT 50""")  # fmt: skip
def _(v):
    sizes = v.chain.groupBy("conv_id").agg(F.count("*").alias("n"))
    return O.newest(sizes, "n", 50, "conv_id")


@query("w1_group_positions", """SELECT id, row_number() OVER (PARTITION BY group_id ORDER BY priority, run_at, group_order, id) AS position
    FROM live WHERE group_id IS NOT NULL""")  # fmt: skip
def _(v):
    blocked = J.unmet(v.dependencies, v.completions)
    waiting = O.claimable(v.jobs, blocked, NOW).where("group_id is not null")
    order = [c(x) for x in ("priority", "run_at", "group_order", "id")]
    return numbered(waiting.select("group_id", *order), "group_id", order, "position").select("id", "position")


@query("w4_dlq_cap", """SELECT entry_id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY entered_at DESC NULLS LAST, entry_id DESC) AS n
    FROM dlq) WHERE n <= 100""")  # fmt: skip
def _(v):
    return M.evict(v.dlq, 100).select("entry_id")


@query("x9_stack_lines", r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, '.', chr(10)), chr(10)),
    lambda x: trim(x, ' ')), lambda x: x <> '')[1:2], '|') AS lines FROM conversations""")  # fmt: skip
def _(v):
    text = F.replace("text", F.lit("."), F.lit("\n"))
    return v.table("conversations").select("conv_id", "turn", F.array_join(X.stack_lines(text, 2), "|").alias("lines"))


@query("x11_dedup_key", """SELECT id, name || ':{"queue":"' || queue || '","priority":' || priority || '}' AS key FROM jobs""")
def _(v):
    return v.jobs.select("id", X.dedup_key(c("name"), c("queue"), c("priority")).alias("key"))


@query("m1_admit", """, new AS (SELECT id || 'n' AS id, CASE WHEN id LIKE '%2' THEN custom_id END AS custom_id, 'v' || substr(id, 11, 2) AS unique_key, row_number() OVER (ORDER BY id) AS ordinal FROM jobs WHERE queue = 'q1'),
a AS (SELECT * FROM new WHERE custom_id IS NULL UNION ALL SELECT * FROM new n WHERE custom_id IS NOT NULL
    AND ordinal = (SELECT min(ordinal) FROM new m WHERE m.custom_id = n.custom_id)
    AND custom_id NOT IN (SELECT custom_id FROM jobs WHERE custom_id IS NOT NULL))
SELECT id FROM a WHERE unique_key NOT IN (SELECT unique_key FROM jobs WHERE stored_state <> 'completed')
    AND ordinal = (SELECT min(ordinal) FROM a b WHERE b.unique_key = a.unique_key)""")  # fmt: skip
def _(v):
    new = v.jobs.where("queue = 'q1'").select(
        F.concat("id", F.lit("n")).alias("id"),
        F.when(c("id").like("%2"), c("custom_id")).alias("custom_id"),
        F.concat(F.lit("v"), F.substring("id", 11, 2)).alias("unique_key"),
        c("id").alias("ordinal"),
    )
    return M.admit(v.jobs, new).select("id")


@query("m2_admit_batch", """, new AS (SELECT id || 'n' AS id, 'v' || substr(id, 10, 2) AS unique_key, id AS ordinal, id LIKE '%7' AS replaces,
    id LIKE '%998' AS invalid FROM jobs WHERE queue = 'q1'),
prefix AS (SELECT * FROM new WHERE ordinal < coalesce((SELECT min(ordinal) FROM new WHERE invalid), 'x')),
held AS (SELECT unique_key, bool_or(stored_state = 'active') AS busy FROM jobs WHERE stored_state <> 'completed' GROUP BY 1)
SELECT id FROM prefix LEFT JOIN held USING (unique_key) WHERE busy IS NULL OR (replaces AND NOT busy)
QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY replaces DESC, CASE WHEN replaces THEN ordinal END DESC, ordinal) = 1""")  # fmt: skip
def _(v):
    new = v.jobs.where("queue = 'q1'").select(
        F.concat("id", F.lit("n")).alias("id"),
        F.concat(F.lit("v"), F.substring("id", 10, 2)).alias("unique_key"),
        c("id").alias("ordinal"),
        c("id").like("%7").alias("replaces"),
        c("id").like("%998").alias("invalid"),
    )
    return M.admit_batch(v.jobs, new).select("id")


@query("m3_admit_flows", """, line AS (SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
node AS (SELECT flow, flow || ':' || n AS id, n, count(*) OVER (PARTITION BY flow) AS size FROM line),
edge AS (SELECT flow, id AS src, flow || ':' || (n - 1) AS dst FROM node WHERE n > 1
    UNION ALL SELECT flow, id, flow || ':' || size FROM node WHERE n = 1 AND flow % 7 = 0
    UNION ALL SELECT flow, id, 'none' FROM node WHERE n = 1 AND flow % 5 = 0),
walk(start, place) AS (SELECT src, dst FROM edge WHERE flow % 7 = 0 UNION SELECT w.start, e.dst FROM walk w JOIN edge e ON e.src = w.place)
SELECT CAST(flow AS BIGINT) AS flow, CASE WHEN bool_or(EXISTS (SELECT 1 FROM edge e WHERE e.flow = o.flow AND e.dst NOT IN (SELECT id FROM node))) THEN 'unknown_dependency'
    WHEN bool_or(EXISTS (SELECT 1 FROM walk WHERE start = place AND start LIKE o.flow || ':%')) THEN 'cycle' ELSE 'accepted' END AS outcome
FROM node o GROUP BY flow""")  # fmt: skip
def _(v):
    kinds = v.table("lineitem").select(c("l_orderkey").cast("bigint").alias("flow"), "l_linenumber").distinct()
    n = F.row_number().over(Window.partitionBy("flow").orderBy("l_linenumber"))
    size = F.count("*").over(Window.partitionBy("flow"))
    line = kinds.withColumns({"n": n, "size": size})
    node = G.written(line.select("flow", F.concat_ws(":", "flow", "n").alias("id"), "n", "size"))
    before = F.when(c("n") > 1, F.concat_ws(":", "flow", c("n") - 1))
    back = F.when((c("n") == 1) & (c("flow") % 7 == 0), F.concat_ws(":", "flow", "size"))
    lost = F.when((c("n") == 1) & (c("flow") % 5 == 0), F.lit("none"))
    edge = node.select("flow", c("id").alias("src"), F.explode(F.array_compact(F.array(before, back, lost))).alias("dst"))
    return M.flow_outcomes(v.jobs, node.select("flow", "id"), edge)


@query("m10_priority", "SELECT id, CASE WHEN queue = 'q1' AND stored_state = 'pending' THEN 9 ELSE priority END AS priority FROM jobs")
def _(v):
    return M.change_priority(v.jobs, v.jobs.where("queue = 'q1'").select("id"), 9).select("id", "priority")


@query("m12_to_wait", f"""SELECT id, CASE WHEN stored_state = 'active' AND queue = 'q1' THEN 'pending' ELSE stored_state END AS stored_state,
    CASE WHEN stored_state = 'active' AND queue = 'q1' THEN {NOW} ELSE run_at END AS run_at FROM jobs""")  # fmt: skip
def _(v):
    return M.to_wait(v.jobs, v.jobs.where("queue = 'q1'").select("id"), NOW).select("id", "stored_state", "run_at")


@query("m14_waiting_children", "SELECT id, CASE WHEN stored_state = 'active' AND queue = 'q1' THEN 'waiting-children' ELSE stored_state END AS stored_state FROM jobs")
def _(v):
    return M.to_waiting_children(v.jobs, v.jobs.where("queue = 'q1'").select("id")).select("id", "stored_state")


@query("m15_discard", f"SELECT id AS job_id, queue, {NOW} AS entered_at, 'unknown' AS reason FROM jobs WHERE queue = 'q1' AND stored_state <> 'completed'")
def _(v):
    return M.discard(v.jobs, v.jobs.where("queue = 'q1'").select("id"), NOW)[1]


@query("m16_pause", "SELECT queue, queue = 'q1' OR paused AS paused FROM queue_state")
def _(v):
    return M.set_paused(v.queue_state, "q1", True).select("queue", "paused")


@query("m18_obliterate", "SELECT id FROM jobs WHERE queue <> 'q1'")
def _(v):
    return M.obliterate(v.jobs, "q1").select("id")


@query("m21_auto_retry", f"""SELECT entry_id, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 < max_auto_retries
    THEN CAST({NOW} + 60000 * pow(2.0, retry_count) AS BIGINT) END AS next_retry_at FROM dlq JOIN queue_state USING (queue)
    WHERE auto_retry AND retry_count < max_auto_retries AND next_retry_at <= {NOW}""")  # fmt: skip
def _(v):
    joined = v.dlq.join(F.broadcast(v.queue_state), "queue")
    return M.auto_retry(joined, P.can_auto_retry(NOW), NOW, 60000).select("entry_id", "retry_count", "next_retry_at")


@query("m22_purge", f"SELECT entry_id FROM dlq WHERE expires_at IS NULL OR expires_at > {NOW}")
def _(v):
    return M.purge_expired(v.dlq, NOW).select("entry_id")


@query("m24_retry_completed", f"""SELECT id, {NOW} AS run_at, 'pending' AS stored_state FROM jobs WHERE queue = 'q1' AND stored_state = 'completed'
    ORDER BY completed_at, id LIMIT 100""")  # fmt: skip
def _(v):
    return M.retry_completed(v.jobs, "q1", NOW, 100).select("id", "run_at", "stored_state")


@query("m26_admitted_edges", """, walk(start, node) AS (SELECT dependency_id, dependency_id FROM cyclic WHERE job_id < dependency_id
    UNION SELECT w.start, d.dependency_id FROM walk w JOIN dependencies d ON d.job_id = w.node)
SELECT job_id AS src, dependency_id AS dst FROM cyclic WHERE job_id < dependency_id
    AND NOT EXISTS (SELECT 1 FROM walk WHERE start = dependency_id AND node = job_id)""")  # fmt: skip
def _(v):
    edges = v.dependencies.select(c("job_id").alias("src"), c("dependency_id").alias("dst"))
    new = v.cyclic.where("job_id < dependency_id").select(c("job_id").alias("src"), c("dependency_id").alias("dst"))
    return G.admitted_edges(edges, new)


@query("m29_unneeded_edges", "SELECT job_id, dependency_id FROM dependencies WHERE job_id NOT IN (SELECT id FROM jobs WHERE stored_state <> 'completed')")
def _(v):
    return M.unneeded_dependencies(v.dependencies, v.jobs)


@query("m29_stale_waiting", f"""SELECT id FROM jobs WHERE stored_state = 'pending' AND created_at < {NOW - 3600000}
    AND id IN (SELECT job_id FROM blocked)""")  # fmt: skip
def _(v):
    return M.stale_waiting(v.jobs, J.unmet(v.dependencies, v.completions), NOW)


@query("o16_capped_queues", """, n AS (SELECT queue, count(*) AS n, row_number() OVER (ORDER BY queue) AS place FROM jobs GROUP BY queue)
SELECT queue, n FROM n WHERE place <= 5 UNION ALL SELECT NULL, count(*) FROM n WHERE place > 5""")  # fmt: skip
def _(v):
    return O.capped(v.jobs.groupBy("queue").agg(F.count("*").alias("n")), "queue", "n", 5)


@query("x13_aging_scan", f"""SELECT id, least(priority + 2, 3) AS priority FROM (
    (SELECT * FROM stated WHERE state = 'waiting' ORDER BY created_at, id LIMIT 100) UNION ALL
    (SELECT * FROM stated WHERE state = 'prioritized' ORDER BY created_at, id LIMIT 100))
    WHERE {NOW} - created_at >= {300 * DAY} AND priority < 3""")  # fmt: skip
def _(v):
    states = A.with_state(v.jobs, v.dead, NOW)
    return M.age_priorities(states, NOW, 300 * DAY, 2, 3, 100)


@query("m31_logs", """SELECT job_id, id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id DESC) AS n
    FROM (SELECT tx AS job_id, id FROM log)) WHERE n <= 5""")  # fmt: skip
def _(v):
    logs = v.events.select(c("tx").alias("job_id"), "id")
    return M.keep_logs(logs.where("id % 2 = 0"), logs.where("id % 2 = 1"), 5)


@query("m32_archive", f"""SELECT id FROM jobs WHERE stored_state = 'completed' AND completed_at <= {NOW - 100 * DAY} ORDER BY completed_at, id LIMIT 500""")
def _(v):
    runs = v.jobs.select("id", c("stored_state").alias("state"), F.coalesce("completed_at", "created_at").alias("updated_at"))
    return M.archive(runs, NOW, 100 * DAY, 500)[0].select("id")


@query("a20_first_orders", "SELECT group_id, min(group_order) AS first_order FROM jobs WHERE group_id IS NOT NULL GROUP BY 1")
def _(v):
    return v.jobs.where("group_id is not null").groupBy("group_id").agg(F.min("group_order").alias("first_order"))


@query("a24_completed_total", "SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM (SELECT count(*) AS n FROM completions GROUP BY queue)")
def _(v):
    by_queue = v.completions.groupBy("queue").agg(F.count("*").alias("n"))
    return by_queue.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("s13_dashboard", """SELECT q.queue, count(j.id) FILTER (stored_state = 'active') AS active, count(j.id) FILTER (stored_state = 'pending') AS pending,
    coalesce(max(c.n), 0) AS completed FROM queue_state q LEFT JOIN jobs j USING (queue) LEFT JOIN (SELECT queue, count(*) AS n
    FROM completions GROUP BY 1) c USING (queue) GROUP BY 1""")  # fmt: skip
def _(v):
    counts = v.jobs.groupBy("queue").agg(
        F.count_if(c("stored_state") == "active").alias("active"), F.count_if(c("stored_state") == "pending").alias("pending")
    )
    done = v.completions.groupBy("queue").agg(F.count("*").alias("completed"))
    joined = v.queue_state.select("queue").join(counts, "queue", "left").join(done, "queue", "left")
    return joined.fillna(0, ["active", "pending", "completed"])


@query("g4_tree_edges", "SELECT conv_id || ':0' AS src, id AS dst FROM chain WHERE turn > 0")
def _(v):
    parent = F.when(c("turn") > 0, F.concat(c("conv_id").cast("string"), F.lit(":0")))
    return G.tree_edges(v.chain.withColumn("parent", parent), "id", "parent")
