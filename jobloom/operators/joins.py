"""Joins over jobs, dependencies and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.ordering import claimable, newest

c = F.col


def unmet(dependencies: DataFrame, completions: DataFrame) -> DataFrame:
    """J1, inner half: jobs that have a dependency without a completion."""
    done = completions.select(c("job_id").alias("dependency_id"))
    return dependencies.join(done, "dependency_id", "left_anti").select("job_id").distinct()


def ready(jobs: DataFrame, dependencies: DataFrame, completions: DataFrame) -> DataFrame:
    """Jobs none of whose dependencies lacks a completion."""
    return jobs.join(unmet(dependencies, completions).select(c("job_id").alias("id")), "id", "left_anti")


def consumers(jobs: DataFrame, dependencies: DataFrame, finished: DataFrame) -> DataFrame:
    """Pending jobs that wait on any of the finished ids."""
    waiting = dependencies.join(finished.select(c("id").alias("dependency_id")), "dependency_id", "left_semi")
    return jobs.where("stored_state = 'pending'").join(waiting.select(c("job_id").alias("id")).distinct(), "id", "left_semi")


def with_group_policy(jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """Jobs with their group's pause flag; no group or no policy is not paused."""
    policy = groups.select("group_id", c("paused").alias("group_paused"))
    return jobs.join(policy, "group_id", "left").withColumn("group_paused", F.coalesce("group_paused", F.lit(False)))


def missing(requested: DataFrame, jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """Requested (id, ordinal) with neither a row nor a completion."""
    return requested.join(jobs.select("id"), "id", "left_anti").join(
        completions.select(c("job_id").alias("id")), "id", "left_anti"
    )


def group_capacity(groups: DataFrame, active: DataFrame, capacity: int, concurrency: int | None, rate: int | None) -> DataFrame:
    """What each open group may still take: least of the capacity, its free slots and its rate's rest."""
    whole = F.lit(capacity)
    slots = whole if concurrency is None else F.greatest(
        F.lit(0), F.coalesce("concurrency_limit", F.lit(concurrency)) - F.coalesce("n_active", F.lit(0))
    )
    rest = whole if rate is None else F.greatest(F.lit(0), F.coalesce("rate_limit", F.lit(rate)) - c("rate_count"))
    return (
        groups.where("not paused")
        .join(active, "group_id", "left")
        .select("group_id", "last_served", F.least(whole, slots, rest).cast("bigint").alias("available"))
    )


def claim_grouped(
    jobs: DataFrame,
    blocked: DataFrame,
    groups: DataFrame,
    now: int,
    capacity: int,
    concurrency: int | None = None,
    rate: int | None = None,
) -> DataFrame:
    """O3 with W1, J5 and J6: each open group's next jobs in turn, up to capacity.

    Within a group the lowest priority number comes first, then time, order and id. A group's jobs are ranked only up
    to the capacity (the filter on the rank limits each task's work), and the last order is a top-k.
    """
    waiting = claimable(jobs, blocked, now).where("group_id is not null")
    by = Window.partitionBy("group_id").orderBy("priority", "run_at", "group_order", "id")
    ranked = waiting.withColumn("group_position", F.row_number().over(by).cast("bigint")).where(c("group_position") <= capacity)
    active = jobs.where("stored_state = 'active' and group_id is not null").groupBy("group_id").agg(F.count("*").alias("n_active"))
    room = group_capacity(groups, active, capacity, concurrency, rate)
    return (
        ranked.join(room, "group_id")
        .where("group_position <= available")
        .orderBy("group_position", c("last_served").asc_nulls_first(), "group_id")
        .limit(capacity)
    )


def outside_groups(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """Groups without live jobs."""
    return groups.join(jobs.where("stored_state <> 'completed'").select("group_id").distinct(), "group_id", "left_anti")


def groups_with_pending(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """J10"""
    return groups.join(jobs.where("stored_state = 'pending'").select("group_id"), "group_id", "left_semi")


def children_values(edges: DataFrame, completions: DataFrame) -> DataFrame:
    """(parent, child key, result) for children that have a result; the key is queue:child."""
    return edges.join(completions.select(c("job_id").alias("dependency_id"), "queue", "result"), "dependency_id").select(
        c("job_id").alias("parent_id"), F.concat_ws(":", "queue", "dependency_id").alias("child_key"), "result"
    )


def dependencies_by_state(edges: DataFrame, completions: DataFrame) -> DataFrame:
    """Numbers of processed and unprocessed dependencies of each parent."""
    done = completions.select(c("job_id").alias("dependency_id"), F.lit(1).alias("is_done"))
    return edges.join(done, "dependency_id", "left").groupBy(c("job_id").alias("parent_id")).agg(
        F.count("is_done").alias("processed"), (F.count("*") - F.count("is_done")).alias("unprocessed")
    )


def pinned_and_recent(completions: DataFrame, dependencies: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """Completions that live jobs need, and the n newest others, with a pinned flag."""
    needed = dependencies.join(live.select(c("id").alias("job_id")), "job_id", "left_semi").select(
        c("dependency_id").alias("job_id")
    ).distinct()
    pinned = completions.join(needed, "job_id", "left_semi").withColumn("pinned", F.lit(True))
    others = newest(completions.join(needed, "job_id", "left_anti"), "completed_at", n, "job_id")
    return pinned.unionByName(others.withColumn("pinned", F.lit(False)))


def by_request(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the requested keys, one or several columns."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def projections(requested: DataFrame, jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """For each requested id its row's state if there is a row, else that a completion tells of it."""
    found = jobs.select("id", c("stored_state").alias("row_state"))
    told = completions.select(c("job_id").alias("id"), F.lit("completed").alias("told"))
    return requested.join(found, "id", "left").join(told, "id", "left").select(
        "id", F.coalesce("row_state", "told", F.lit("unknown")).alias("state"), c("row_state").isNotNull().alias("has_row")
    )


def journal(events: DataFrame, commits: DataFrame, after: Column) -> DataFrame:
    """Events in commit order, after a cursor."""
    return events.join(commits, "tx").where(after)
