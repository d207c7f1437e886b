"""Predicates over job columns (F1 to F19). Every one takes the clock as an argument; none reads the machine's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col
#: What a queue's stall check uses unless it is told otherwise.
STALL_INTERVAL, GRACE_PERIOD, MAX_STALLS = 30_000, 5_000, 3


def logical_state(now: int, dead: Column | None = None) -> Column:
    """failed if dead; else completed, active and waiting-children as stored; else by run_at and priority."""
    state = (
        F.when(c("stored_state").isin("completed", "active", "waiting-children"), c("stored_state"))
        .when(c("run_at") > now, "delayed")
        .when(c("priority") > 0, "prioritized")
        .otherwise("waiting")
    )
    return state if dead is None else F.when(dead, "failed").otherwise(state)


def is_delayed(now: int) -> Column:
    """to run later."""
    return c("run_at") > now


def is_expired(now: int) -> Column:
    """past its time to live; the last millisecond still counts."""
    return F.coalesce(c("created_at") + c("ttl") < now, F.lit(False))


def is_timed_out(now: int) -> Column:
    """F4, one job: running for longer than its timeout."""
    return F.coalesce(c("started_at") + c("timeout") < now, F.lit(False))


def is_timeout_due(now: int) -> Column:
    """F4, the sweep: the deadline itself counts."""
    return F.coalesce(c("started_at") + c("timeout") <= now, F.lit(False))


def can_retry() -> Column:
    """F5"""
    return c("attempts") < c("max_attempts")


def in_states(states: list[str], now: int) -> Column:
    """any of the states, as predicates on stored columns that a scan can be given."""
    pending = c("stored_state") == "pending"
    tests = {
        "waiting": pending & (c("run_at") <= now) & (c("priority") <= 0),
        "prioritized": pending & (c("run_at") <= now) & (c("priority") > 0),
        "delayed": pending & (c("run_at") > now),
    }
    return reduce(Column.__or__, [tests.get(s, c("stored_state") == s) for s in states])


def is_dlq_expired(now: int) -> Column:
    """from the moment of expiry on."""
    return F.coalesce(c("expires_at") <= now, F.lit(False))


def can_auto_retry(now: int) -> Column:
    """switched on, retries left, and due."""
    return F.coalesce(
        c("auto_retry") & (c("retry_count") < c("max_auto_retries")) & (c("next_retry_at") <= now), F.lit(False)
    )


def stall_action(now: int, interval: int = STALL_INTERVAL, grace: int = GRACE_PERIOD, most: int = MAX_STALLS) -> Column:
    """keep, retry or move_to_dlq.

    Nothing stalls before its grace period is over; silence must pass the job's own stall_timeout or, without one, interval.
    """
    early = c("started_at").isNull() | (now - c("started_at") < grace)
    quiet = now - c("heartbeat_at") <= F.coalesce("stall_timeout", F.lit(interval))
    return (
        F.when(early | F.coalesce(quiet, F.lit(True)), "keep")
        .when(c("stall_count") + 1 >= most, "move_to_dlq")
        .otherwise("retry")
    )


def is_key_expired(now: int) -> Column:
    """F13"""
    return F.coalesce(c("expires_at") <= now, F.lit(False))


def is_cron_due(now: int) -> Column:
    """its time has come and its limit, if any, is not reached."""
    return (c("next_run") <= now) & (c("max_limit").isNull() | (c("executions") < c("max_limit")))


def group_open(active: Column) -> Column:
    """not paused, and room under its concurrency and its rate."""
    room = c("concurrency_limit").isNull() | (active < c("concurrency_limit"))
    return ~c("paused") & room & (c("rate_limit").isNull() | (c("rate_count") < c("rate_limit")))


def webhook_matches(event: Column, queue: Column) -> Column:
    """F16: switched on, wants the event, and is for this queue or for all."""
    return c("enabled") & F.array_contains(c("wanted"), event) & (c("for_queue").isNull() | (c("for_queue") == queue))


def name_ttl_passed(now: int, ttl: Column) -> Column:
    """older than its name's time to live; none or zero means never."""
    return F.coalesce((ttl > 0) & (now - c("created_at") > ttl), F.lit(False))
