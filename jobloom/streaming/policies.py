"""Keyed sequential policies (T4 to T8, T10): each is a small fold over one key's events in order of time.

A policy maps (state, time) to (decision, state); state is a tuple of numbers. The same policies run over a batch, key
by key in sorted partitions, and over a stream with keyed state that is dropped when it can no longer matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple
Policy = Callable[..., tuple[str, State]]


def dedup(ttl: int, mode: str = "reject") -> Policy:
    """T4: the first of a key is new; while its time to live lasts, others are duplicates (reject), prolong it (extend)
    or take its place and its time (replace)."""

    def step(state: State, at: int) -> tuple[str, State]:
        if not state or at >= state[0]:
            return "new", (at + ttl,)
        if mode == "reject":
            return "duplicate", state
        return ("extended" if mode == "extend" else "replaced"), (at + ttl,)

    return step


def dedup_owned(ttl: int, mode: str = "reject") -> Policy:
    """T4 where the owner's state counts: the event also tells whether the key's owner is queued, active or gone.

    extend prolongs the key; with a queued owner the event is skipped, else it is an error. replace takes a queued
    owner's place, waits behind an active one, and is new where the owner is gone. reject skips while the owner lives.
    """

    def step(state: State, at: int, owner: str) -> tuple[str, State]:
        if not state or at >= state[0]:
            return "new", (at + ttl,)
        if mode == "extend":
            return ("extended" if owner == "queued" else "error"), (at + ttl,)
        if mode == "replace":
            made = {"queued": "replaced", "active": "behind_active"}.get(owner, "new")
            return made, (at + ttl,) if made != "behind_active" else state
        return ("duplicate", state) if owner != "gone" else ("new", (at + ttl,))

    return step


def lasting(least: int) -> Policy:
    """T18, idle and overload: an alert when what is checked has lasted so long, after which it starts anew.

    Checks at which it holds are positive times, others negative ones.
    """

    def step(state: State, at: int) -> tuple[str, State]:
        if at < 0:
            return "ended", ()
        since = state[0] if state else at
        return ("alert", ()) if state and at - since >= least else ("holds", (since,))

    return step


def token_bucket(capacity: float, per_second: float) -> Policy:
    """T6, memory: tokens refill continuously up to capacity; each start takes one."""

    def step(state: State, at: int) -> tuple[str, State]:
        tokens, last = state or (float(capacity), at)
        tokens = min(float(capacity), tokens + (at - last) / 1000 * per_second)
        return ("allowed", (tokens - 1, at)) if tokens >= 1 else ("limited", (tokens, at))

    return step


def fixed_window(most: int, duration: int) -> Policy:
    """T6, stored, and T7: a window opens with a start and admits so many until it ends."""

    def step(state: State, at: int) -> tuple[str, State]:
        opened, used = state if state and at < state[0] + duration else (at, 0)
        return ("allowed", (opened, used + 1)) if used < most else ("limited", (opened, used))

    return step


def sliding_log(most: int, duration: int) -> Policy:
    """At most so many starts within the duration before any start; one exactly that old no longer counts."""

    def step(state: State, at: int) -> tuple[str, State]:
        recent = tuple(t for t in state if t > at - duration)
        return ("allowed", (*recent, at)) if len(recent) < most else ("limited", recent)

    return step


def two_sweeps(interval: int) -> Policy:
    """A job silent for longer than the interval is a candidate at one sweep and stalled at the next.

    Events are heartbeats (positive times) and sweeps (negative ones).
    """

    def step(state: State, at: int) -> tuple[str, State]:
        beat, candidate = state or (abs(at), 0)
        if at >= 0:
            return "beat", (at, candidate)
        silent = -at - beat > interval
        if candidate and silent:
            return "stalled", (beat, 0)
        return ("candidate" if silent else "live"), (beat, int(silent))

    return step


def run_batch(
    events: DataFrame,
    key: str,
    at: str,
    policy: Policy,
    tie: str = "id",
    value: str | None = None,
    decision: str = "decision",
    also: str | None = None,
) -> DataFrame:
    """events with a decision, each key's in order of (at, tie); the policy is given the time or another value, and `also`.

    Keys are dealt by hash and sorted within their partition; a task streams over its rows and holds one key's state.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), ()
        for frame in frames:
            found = []
            more = [()] * len(frame) if also is None else [(x,) for x in frame[also]]
            for k, t, x in zip(frame[key], frame[value or at], more, strict=True):
                if k != current:
                    current, state = k, ()
                made, state = policy(state, int(t), *x)
                found.append(made)
            yield frame.assign(**{decision: found})

    dealt = events.repartition(key).sortWithinPartitions(key, at, tie)
    schema = ", ".join(f"`{n}` {kind}" for n, kind in dealt.dtypes) + f", `{decision}` string"
    return dealt.mapInPandas(fold, schema)


def run_stream(events: DataFrame, key: str, at: str, policy: Policy, idle: int, tie: str = "id") -> DataFrame:
    """(key, tie, at, decision) over a stream; a key's state goes when it is idle for so many milliseconds."""
    kinds = dict(events.dtypes)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept: State = tuple(state.get[0]) if state.exists else ()
        frame = pd.concat(list(frames)).sort_values([at, tie])
        found = []
        for t in frame[at]:
            made, kept = policy(kept, int(t))
            found.append(made)
        state.update((list(map(float, kept)),))
        state.setTimeoutDuration(idle)
        yield frame[[key, tie, at]].assign(decision=found)

    return events.groupBy(key).applyInPandasWithState(
        fold,
        f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, `{at}` {kinds[at]}, decision string",
        "kept array<double>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
