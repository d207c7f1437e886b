"""Orders, limits and pages (O1 to O15). Every order ends with the id, so that pages don't overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.predicates import in_states, is_expired

c = F.col


def ready_order() -> list[Column]:
    """O1: priority first; then last-in-first-out jobs, newest id first; then the others by time and id."""
    return [
        c("priority").desc(),
        F.when(c("lifo"), 0).otherwise(1).asc(),
        F.when(c("lifo"), c("id")).desc(),
        F.when(~c("lifo"), c("run_at")).asc(),
        c("id").asc(),
    ]


def page(rows: DataFrame, start: int, end: int, asc: bool = True, by: str = "created_at") -> DataFrame:
    """Rows start to end, exclusive, in order of time and id."""
    order = [c(by).asc(), c("id").asc()] if asc else [c(by).desc(), c("id").desc()]
    return rows.orderBy(*order).offset(start).limit(max(0, end - start))


def list_jobs(jobs: DataFrame, states: list[str], now: int, start: int = 0, end: int = 100, asc: bool = True) -> DataFrame:
    """F6 with O6: a page of the jobs in some logical states."""
    return page(jobs.where(in_states(states, now)), start, end, asc)


def overlay(stored: DataFrame, buffered: DataFrame) -> DataFrame:
    """Buffered rows replace stored ones of the same id."""
    return stored.join(buffered.select("id"), "id", "left_anti").unionByName(buffered)


def after_key(rows: DataFrame, at: int, last_id: str, limit: int, time: Column) -> DataFrame:
    """The next page after (time, id)."""
    later = (time > at) | ((time == at) & (c("id") > last_id))
    return rows.withColumn("sort_time", time).where(later).orderBy("sort_time", "id").limit(limit)


def newest(rows: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    """The n newest."""
    return rows.orderBy(c(by).desc(), c(tie).desc()).limit(n)


def overflow(rows: DataFrame, by: str, keep: int, tie: str = "id") -> DataFrame:
    """What is beyond the newest `keep` rows; the kept are few and leave by an anti-join, so nothing is ranked."""
    return rows.join(newest(rows, by, keep, tie).select(tie), tie, "left_anti")


def oldest_before(rows: DataFrame, before: int, n: int) -> DataFrame:
    """The n oldest created at or before a time."""
    return rows.where(c("created_at") <= before).orderBy("created_at", "id").limit(n)


def claimable(jobs: DataFrame, blocked: DataFrame, now: int) -> DataFrame:
    """Jobs that may run now: pending, due, not expired, and with no unmet dependency (ids in blocked)."""
    due = jobs.where((c("stored_state") == "pending") & (c("run_at") <= now) & ~is_expired(now))
    return due.join(blocked.select(c("job_id").alias("id")), "id", "left_anti")


def capped(counts: DataFrame, name: str, value: str, most: int) -> DataFrame:
    """The first so many names in order, then a row without a name that tells how many are left out."""
    shown = counts.orderBy(name).limit(most)
    left_out = counts.agg(F.greatest(F.count("*") - most, F.lit(0)).alias(value)).select(F.lit(None).cast("string").alias(name), value)
    return shown.select(name, value).unionByName(left_out)
