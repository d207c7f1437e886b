"""Lifecycle transitions as pure functions from tables to tables (M1 to M32). One writer is assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.cron import cron_next
from jobloom.functions.predicates import in_states, is_expired
from jobloom.functions.scalars import aged_priority, server_backoff
from jobloom.operators.graph import cyclic_flows
from jobloom.operators.joins import claim_grouped
from jobloom.operators.ordering import claimable, oldest_before, ready_order

c = F.col


def changed(jobs: DataFrame, ids: DataFrame, allowed: Column, **to: Column) -> DataFrame:
    """Set columns of the listed jobs where allowed; all other rows stay as they are."""
    marks = ids.select("id", F.lit(True).alias("is_listed")).distinct()
    hit = F.coalesce(c("is_listed") & allowed, F.lit(False))
    joined = jobs.join(marks, "id", "left")
    return joined.withColumns({k: F.when(hit, v).otherwise(c(k)) for k, v in to.items()}).select(jobs.columns)


def latest_wins(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert; of rows with equal keys the last by order stays, a change before a stored row of equal order."""
    both = stored.withColumn("from_change", F.lit(0)).unionByName(changes.withColumn("from_change", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy(c(order).desc(), c("from_change").desc())
    return both.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank", "from_change")


def admit(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1, M2: the incoming rows that are inserted: of equal custom ids or unique keys the first, none that a live job has.

    incoming has an `ordinal`. Null ids and keys never clash.
    """
    def free(rows: DataFrame, key: str, live: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))
        alone = rows.where(c(key).isNull())
        named = rows.where(c(key).isNotNull()).withColumn("n", first).where("n = 1").drop("n")
        return alone.unionByName(named.join(live.where(c(key).isNotNull()).select(key), key, "left_anti").select(rows.columns))

    live = jobs.where("stored_state <> 'completed'")
    return free(free(incoming, "custom_id", jobs), "unique_key", live)


def capacity(count: int, active: int, concurrency: int | None, rate_rest: int | None) -> int:
    """M4: how many a pull may take."""
    rooms = [count]
    if concurrency is not None:
        rooms.append(max(0, concurrency - active))
    if rate_rest is not None:
        rooms.append(max(0, rate_rest))
    return min(rooms)


def pull(jobs: DataFrame, blocked: DataFrame, groups: DataFrame, now: int, count: int) -> DataFrame:
    """M4 with O2 to O4: ids to mark active: jobs without a group first, then groups in turn for what is left."""
    alone = claimable(jobs, blocked, now).where("group_id is null").orderBy(*ready_order()).limit(count)
    taken = alone.count()
    first = alone.select("id", F.lit(0).alias("source"))
    if taken >= count:
        return first
    grouped = claim_grouped(jobs, blocked, groups, now, count - taken)
    return first.unionByName(grouped.select("id", F.lit(1).alias("source")))


def activate(jobs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """M4: mark pulled jobs active."""
    at = F.lit(now).cast("bigint")
    return changed(jobs, ids, c("stored_state") == "pending", stored_state=F.lit("active"), started_at=at, heartbeat_at=at)


def complete(jobs: DataFrame, acks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """M5, M6: jobs with acked active ones completed, and their completions (job_id, queue, completed_at, result)."""
    active = acks.join(jobs.where("stored_state = 'active'").select("id", "queue"), "id")
    done = active.select(c("id").alias("job_id"), "queue", F.lit(now).cast("bigint").alias("completed_at"), "result")
    return changed(
        jobs, active, c("stored_state") == "active", stored_state=F.lit("completed"), completed_at=F.lit(now).cast("bigint")
    ), done


def fail(jobs: DataFrame, failures: DataFrame, now: int, delay: int = 1000) -> dict[str, DataFrame]:
    """M7: failed active jobs, one attempt more: to `retry` with backoff, to `remove`, or to the `dlq`.

    failures (id, unrecoverable, remove). `rest` is every other job.
    """
    hit = jobs.where("stored_state = 'active'").join(failures, "id").withColumn("attempts", c("attempts") + 1)
    again = ~c("unrecoverable") & (c("attempts") < c("max_attempts"))
    wait = server_backoff(F.lit("exponential"), F.lit(delay), c("attempts")).cast("bigint")
    retry = hit.where(again).withColumns(
        {"stored_state": F.lit("pending"), "run_at": F.lit(now) + wait, "started_at": F.lit(None).cast("bigint")}
    )
    gone = hit.where(~again)
    return {
        "retry": retry.select(jobs.columns),
        "remove": gone.where("remove").select(jobs.columns),
        "dlq": gone.where("not remove").select(jobs.columns),
        "rest": jobs.join(hit.select("id"), "id", "left_anti"),
    }


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """M8: without the listed pending jobs; active ones are not cancelled."""
    gone = jobs.where("stored_state in ('pending', 'waiting-children')").join(ids, "id", "left_semi")
    return jobs.join(gone.select("id"), "id", "left_anti")


def update_progress(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """M9: progress of active jobs, held between 0 and 100."""
    new = updates.select("id", c("progress").alias("new_progress"))
    held = F.greatest(F.lit(0), F.least(F.lit(100), c("new_progress")))
    hit = c("new_progress").isNotNull() & (c("stored_state") == "active")
    return jobs.join(new, "id", "left").withColumn("progress", F.when(hit, held).otherwise(c("progress"))).select(jobs.columns)


def change_priority(jobs: DataFrame, ids: DataFrame, priority: int) -> DataFrame:
    """M10"""
    return changed(jobs, ids, c("stored_state") == "pending", priority=F.lit(priority))


def promote(jobs: DataFrame, now: int, n: int) -> DataFrame:
    """The n oldest delayed jobs run now."""
    some = jobs.where(in_states(["delayed"], now)).orderBy("created_at", "id").limit(n)
    return changed(jobs, some, F.lit(True), run_at=F.lit(now).cast("bigint"))


def to_wait(jobs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """M12"""
    none = F.lit(None).cast("bigint")
    at = F.lit(now).cast("bigint")
    return changed(jobs, ids, c("stored_state") == "active", stored_state=F.lit("pending"), run_at=at, started_at=none)


def delay(jobs: DataFrame, ids: DataFrame, now: int, ms: int, active: bool = False) -> DataFrame:
    """Run later; queued jobs, or active ones, which then wait again."""
    at = F.lit(now + ms).cast("bigint")
    if not active:
        return changed(jobs, ids, c("stored_state") == "pending", run_at=at)
    none = F.lit(None).cast("bigint")
    return changed(jobs, ids, c("stored_state") == "active", stored_state=F.lit("pending"), run_at=at, started_at=none)


def to_waiting_children(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """M14"""
    return changed(jobs, ids, c("stored_state") == "active", stored_state=F.lit("waiting-children"))


def discard(jobs: DataFrame, ids: DataFrame, now: int, reason: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """Jobs without the discarded ones, and these as dead-letter entries."""
    gone = jobs.where("stored_state in ('pending', 'active')").join(ids, "id", "left_semi")
    entries = gone.select(c("id").alias("job_id"), "queue", F.lit(now).cast("bigint").alias("entered_at"), F.lit(reason).alias("reason"))
    return jobs.join(gone.select("id"), "id", "left_anti"), entries


def drain(jobs: DataFrame, queue: str) -> DataFrame:
    """Without the queue's pending jobs."""
    return jobs.where((c("queue") != queue) | (c("stored_state") != "pending"))


def obliterate(jobs: DataFrame, queue: str) -> DataFrame:
    """Without anything of the queue."""
    return jobs.where(c("queue") != queue)


def clean(jobs: DataFrame, now: int, grace: int, state: str | None = None, limit: int = 1000) -> DataFrame:
    """Ids that a clean removes: the oldest past the grace; all pending states mean the same, active none."""
    if state in (None, "waiting", "delayed", "prioritized", "paused"):
        return oldest_before(jobs.where("stored_state = 'pending'"), now - grace, limit).select("id")
    if state == "completed":
        return jobs.where((c("stored_state") == "completed") & (c("completed_at") <= now - grace)).orderBy("completed_at", "id").limit(limit).select("id")
    return jobs.select("id").limit(0)


def retry_dlq(dlq: DataFrame, oldest: int) -> DataFrame:
    """Entries of the oldest n to requeue; of equal jobs the oldest."""
    some = dlq.orderBy("entered_at", "entry_id").limit(oldest)
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("entered_at", "entry_id"))
    return some.withColumn("n", first).where("n = 1").drop("n")


def auto_retry(dlq: DataFrame, due: Column, now: int, interval: int) -> DataFrame:
    """Due entries with one retry more and the time of the next."""
    after = c("retry_count") + 1
    following = F.when(after < c("max_auto_retries"), (now + interval * F.pow(F.lit(2.0), after - 1)).cast("bigint"))
    return dlq.where(due).withColumn("next_retry_at", following).withColumn("retry_count", after)


def expire(jobs: DataFrame, now: int, limit: int = 1000) -> DataFrame:
    """Ids of the oldest pending jobs past their time to live."""
    return jobs.where((c("stored_state") == "pending") & is_expired(now)).orderBy("created_at", "id").limit(limit).select("id")


def recover(jobs: DataFrame, now: int, lease: int) -> DataFrame:
    """Active jobs whose lease ran out, and whether they are retried or go to the dead-letter queue."""
    lost = jobs.where((c("stored_state") == "active") & (c("heartbeat_at") + lease <= now))
    again = c("attempts") + 1 < c("max_attempts")
    return lost.select("id", "queue", F.when(again, "retry").otherwise("dlq").alias("to"))


def resolve_flow_failures(jobs: DataFrame, edges: DataFrame, failures: DataFrame, completions: DataFrame) -> DataFrame:
    """What becomes of parents of failed children: fail, ready or wait.

    failures (parent_id, child_id, mode). fail fails the parent; continue frees it of all dependencies; remove and
    ignore free it of the child; it is ready when what is left is complete.
    """
    modes = failures.groupBy(c("parent_id").alias("id")).agg(
        F.bool_or(c("mode") == "fail").alias("fails"), F.bool_or(c("mode") == "continue").alias("goes_on")
    )
    freed = failures.select(c("parent_id").alias("job_id"), c("child_id").alias("dependency_id"))
    open_edges = edges.join(freed, ["job_id", "dependency_id"], "left_anti").join(
        completions.select(c("job_id").alias("dependency_id")), "dependency_id", "left_anti"
    )
    waits = open_edges.select(c("job_id").alias("id"), F.lit(True).alias("waits")).distinct()
    parents = jobs.where("stored_state = 'pending'").join(modes, "id").join(waits, "id", "left")
    outcome = F.when(c("fails"), "fail").when(c("goes_on") | c("waits").isNull(), "ready").otherwise("wait")
    return parents.select("id", outcome.alias("outcome"))


def repeat_successors(done: DataFrame, now: int) -> DataFrame:
    """The next run of repeating jobs, while under their limit and end."""
    following = F.lit(now) + c("every")
    more = (c("max_runs").isNull() | (c("runs") + 1 < c("max_runs"))) & (c("end_at").isNull() | (following <= c("end_at")))
    return done.where(more).withColumn("runs", c("runs") + 1).withColumn("run_at", following)


def set_paused(queue_state: DataFrame, queue: str, paused: bool) -> DataFrame:
    """M16"""
    return queue_state.withColumn("paused", F.when(c("queue") == queue, F.lit(paused)).otherwise(c("paused")))


def purge_expired(dlq: DataFrame, now: int) -> DataFrame:
    """Entries that have not expired."""
    return dlq.where(c("expires_at").isNull() | (c("expires_at") > now))


def evict(dlq: DataFrame, most: int) -> DataFrame:
    """Each queue's newest entries up to a number."""
    by = Window.partitionBy("queue").orderBy(c("entered_at").desc_nulls_last(), c("entry_id").desc())
    return dlq.withColumn("keep_rank", F.row_number().over(by)).where(c("keep_rank") <= most).drop("keep_rank")


def retry_completed(jobs: DataFrame, queue: str, now: int, limit: int) -> DataFrame:
    """The queue's completed jobs, oldest first and so many at most, as pending jobs."""
    some = jobs.where((c("queue") == queue) & (c("stored_state") == "completed")).orderBy("completed_at", "id").limit(limit)
    none = F.lit(None).cast("bigint")
    to = {"stored_state": F.lit("pending"), "run_at": F.lit(now).cast("bigint"), "attempts": F.lit(0), "started_at": none, "completed_at": none}
    return some.withColumns(to)


def keep_logs(logs: DataFrame, added: DataFrame, most: int) -> DataFrame:
    """Logs with the added lines, each job's newest so many."""
    by = Window.partitionBy("job_id").orderBy(c("id").desc())
    both = logs.unionByName(added).withColumn("n", F.row_number().over(by))
    return both.where(c("n") <= most).drop("n")


def archive(executions: DataFrame, now: int, age: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Finished executions not updated for an age, oldest first and so many at most; and what stays."""
    old = executions.where(c("state").isin("completed", "failed") & (c("updated_at") <= now - age))
    gone = old.orderBy("updated_at", "id").limit(limit)
    return gone, executions.join(gone.select("id"), "id", "left_anti")


def unneeded_dependencies(dependencies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Edges of jobs that are gone or done."""
    live = jobs.where("stored_state <> 'completed'").select(c("id").alias("job_id"))
    return dependencies.join(live, "job_id", "left_anti")


def stale_waiting(jobs: DataFrame, blocked: DataFrame, now: int, age: int = 3_600_000) -> DataFrame:
    """Pending jobs that have waited for a dependency for longer than an age."""
    old = jobs.where((c("stored_state") == "pending") & (c("created_at") < now - age))
    return old.join(blocked.select(c("job_id").alias("id")), "id", "left_semi").select("id")


def admit_batch(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """M2: the rows of a batch (id, unique_key, ordinal, replaces, invalid) that are inserted.

    The rows before the first invalid one stay. Of equal keys the last that replaces supersedes the others, else the
    first stays. A key that a live job holds admits only rows that replace it, and none while that job is active.
    """
    first_bad = incoming.where("invalid").agg(F.min("ordinal").alias("first_bad"))
    prefix = incoming.join(F.broadcast(first_bad), F.lit(True), "left").where("first_bad is null or ordinal < first_bad")
    held = jobs.where("stored_state <> 'completed' and unique_key is not null").groupBy("unique_key")
    held = held.agg(F.bool_or(c("stored_state") == "active").alias("is_busy"))
    free = prefix.join(held, "unique_key", "left").where("is_busy is null or (replaces and not is_busy)")
    last = F.when(c("replaces"), c("ordinal"))
    by = Window.partitionBy("unique_key").orderBy(c("replaces").desc(), last.desc(), "ordinal")
    named = free.where("unique_key is not null").withColumn("n", F.row_number().over(by)).where("n = 1")
    return named.select(incoming.columns).unionByName(free.where("unique_key is null").select(incoming.columns))


def flow_outcomes(jobs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M3: (flow, outcome) for flows of nodes (flow, id) and edges (flow, src, dst: src depends on dst): all or nothing.

    accepted, or the first that holds: an id that exists or stands twice, a dependency that is neither in the flow nor a
    job, a cycle.
    """
    named = nodes.select("flow", "id", F.lit(1).alias("n"), F.lit(False).alias("asked"))
    needed = edges.select("flow", c("dst").alias("id"), F.lit(0).alias("n"), F.lit(True).alias("asked"))
    ids = named.unionByName(needed).groupBy("flow", "id").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    known = ids.join(jobs.select("id", F.lit(True).alias("found")).distinct(), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    taken = (c("n") > 1) | (c("n") > 0) & c("found")
    lost = c("asked") & ~c("found") & ((c("n") == 0) | c("id").isNull())
    flows = known.groupBy("flow").agg(F.bool_or(taken).alias("taken"), F.bool_or(lost).alias("lost"), F.sum("n").alias("n")).where("n > 0")
    flows = flows.join(cyclic_flows(edges).withColumn("round_again", F.lit(True)), "flow", "left")
    outcome = F.when(c("taken"), "existing_id").when(c("lost"), "unknown_dependency").when(c("round_again"), "cycle").otherwise("accepted")
    return flows.select("flow", outcome.alias("outcome"))


def cron_tick(crons: DataFrame, workers: DataFrame, now: int) -> DataFrame:
    """The due crons with outcome, executions and next_run.

    At its limit a cron is removed. It is skipped where its queue has no worker and it asks for one, or when it last
    fired less than 80 % of its interval ago (of a minute for schedules); else it fires. A skipped cron moves on too.
    """
    known = workers.select("queue", F.lit(True).alias("has_worker")).distinct()
    due = crons.where(c("next_run") <= now).join(known, "queue", "left")
    recent = now - c("last_fired") < 0.8 * F.coalesce("repeat_every", F.lit(60_000))
    outcome = (
        F.when(c("executions") >= c("max_limit"), "removed")
        .when(c("skip_without_worker") & c("has_worker").isNull(), "no-worker")
        .when(recent, "overlap")
        .otherwise("fired")
    )
    at = F.lit(now).cast("bigint")
    periods = F.greatest(F.lit(1), F.ceil((now + 1 - c("next_run")) / c("repeat_every")))
    by_interval = c("next_run") + c("repeat_every") * periods
    following = F.when(c("schedule").isNotNull(), cron_next("schedule", at, "zone")).otherwise(F.coalesce(by_interval, at))
    judged = due.withColumn("outcome", outcome)
    return judged.withColumns(
        {
            "executions": (c("executions") + (c("outcome") == "fired").cast("int")).cast("int"),
            "next_run": F.when(c("outcome") != "removed", following.cast("bigint")),
        }
    ).drop("has_worker")


def age_priorities(jobs: DataFrame, now: int, least_age: int, boost: int, most: int, scan: int) -> DataFrame:
    """(id, priority) of jobs whose priority rises, among the oldest `scan` waiting and `scan` prioritized ones."""
    pages = [jobs.where(c("state") == s).orderBy("created_at", "id").limit(scan) for s in ("waiting", "prioritized")]
    old = (now - c("created_at") >= least_age) & (c("priority") < most)
    return pages[0].unionByName(pages[1]).where(old).select("id", aged_priority(now, least_age, boost, most).alias("priority"))
