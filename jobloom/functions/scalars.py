"""Scalar functions over job columns (X2 to X13). Jitter is an input, 1 where none is wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MAX_DELAY = 3_600_000
TIMELINE_LENGTH = 20
DEDUP_TTL = 3_600_000


def server_backoff(kind: Column, delay: Column, attempts: Column, jitter: Column | float = 1.0) -> Column:
    """The delay, doubled for each attempt unless fixed, times jitter, and never above the most."""
    base = F.when(kind == "fixed", delay.cast("double")).otherwise(delay * F.pow(F.lit(2.0), attempts))
    return F.least(base * jitter, F.lit(float(MAX_DELAY)))


def client_backoff(strategy: Column, attempt: Column, delay: Column, jitter: Column | float = 1.0) -> Column:
    """Fixed, exponential, jitter (rounded down) or fibonacci (1, 2, 3, 5, ...)."""
    doubled = delay * F.pow(F.lit(2.0), attempt - 1)
    pair = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    steps = F.when(attempt > 1, F.sequence(F.lit(1), attempt - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    fib = F.aggregate(
        steps, pair, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["b"]
    )
    return (
        F.when(strategy == "exponential", doubled)
        .when(strategy == "jitter", F.floor(doubled * jitter).cast("double"))
        .when(strategy == "fibonacci", (delay * fib).cast("double"))
        .otherwise(delay.cast("double"))
    )


def dlq_next_retry(now: int, interval: int, retries: Column, most: Column) -> Column:
    """The time after one more retry, with doubling intervals; null when that was the last."""
    after = retries + 1
    return F.when(after < most, (now + interval * F.pow(F.lit(2.0), after - 1)).cast("bigint"))


def next_interval_run(previous: Column, every: Column, now: int, start: Column, offset: Column) -> Column:
    """The next run of an interval, moved on by whole intervals until it is after now and not before start."""
    earliest = F.greatest(F.lit(now + 1).cast("bigint"), start)
    later = F.coalesce(offset, F.lit(0))
    first = F.when(start > now, start + later).otherwise(now + every + later)
    plain = F.coalesce(previous + every, first)
    missed = F.ceil((earliest - plain) / every) * every
    return F.when(plain < earliest, plain + missed).otherwise(plain).cast("bigint")


def stack_lines(stack: Column, most: int) -> Column:
    """Lines trimmed, empty ones dropped, at most so many."""
    trimmed = F.transform(F.split(stack, "\n"), lambda line: F.trim(line))
    return F.slice(F.filter(trimmed, lambda line: line != ""), 1, most)


def timeline_append(timeline: Column, entry: Column) -> Column:
    """The timeline with entry, unless it is full."""
    return F.when(F.size(timeline) < TIMELINE_LENGTH, F.array_append(timeline, entry)).otherwise(timeline)


def dedup_key(name: Column, *data: Column) -> Column:
    """X11: name and data as JSON."""
    return F.concat_ws(":", name, F.to_json(F.struct(*data)))


def last_lines(lines: Column, most: int) -> Column:
    """The newest lines."""
    return F.when(F.size(lines) > most, F.slice(lines, -most, most)).otherwise(lines)


def aged_priority(now: int, least_age: int, boost: int, most: int) -> Column:
    """Old enough jobs gain priority up to a limit."""
    old = now - F.col("created_at") >= least_age
    return F.when(old & (F.col("priority") < most), F.least(F.col("priority") + boost, F.lit(most))).otherwise(F.col("priority"))
