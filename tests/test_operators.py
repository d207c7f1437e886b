"""Hand-computed cases, both sides of each boundary."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions import cron
from jobloom.functions import predicates as P
from jobloom.functions import processors as D
from jobloom.functions import scalars as X
from jobloom.operators import aggregates as A
from jobloom.operators import graph as G
from jobloom.operators import joins as J
from jobloom.operators import lifecycle as M
from jobloom.operators import ordering as O
from jobloom.operators.ranking import numbered
from jobloom.streaming import policies as T

JOB = (
    "id string, queue string, priority int, created_at bigint, run_at bigint, stored_state string, lifo boolean, "
    "group_id string, group_order bigint, ttl bigint, attempts int, max_attempts int, started_at bigint, "
    "completed_at bigint, heartbeat_at bigint, progress int"
)


def job(id, queue="q", priority=0, created_at=0, run_at=0, state="pending", lifo=False, group=None, order=0, ttl=None,
        attempts=0, started=None, done=None, beat=None, progress=0):
    return (id, queue, priority, created_at, run_at, state, lifo, group, order, ttl, attempts, 3, started, done, beat, progress)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_state_boundaries(spark):
    rows = [job("a", run_at=100), job("b", run_at=101), job("c", priority=1), job("d", state="active", run_at=500)]
    states = spark.createDataFrame(rows, JOB).select("id", P.logical_state(100).alias("s"))
    assert {r.id: r.s for r in states.collect()} == {"a": "waiting", "b": "delayed", "c": "prioritized", "d": "active"}


def test_expiry_is_strict(spark):
    rows = [job("a", ttl=100), job("b", ttl=99), job("c")]
    assert values(spark.createDataFrame(rows, JOB).where(P.is_expired(100)), "id") == ["b"]


@pytest.mark.parametrize(("now", "one", "sweep"), [(99, False, False), (100, False, True), (101, True, True)])
def test_timeout_boundaries(spark, now, one, sweep):
    row = spark.createDataFrame([(50, 50)], "started_at bigint, timeout bigint").select(
        P.is_timed_out(now).alias("one"), P.is_timeout_due(now).alias("sweep")
    ).first()
    assert (row.one, row.sweep) == (one, sweep)


def test_stall_actions(spark):
    rows = [("grace", 96_000, 0, 0, None), ("quiet", 0, 70_000, 0, None), ("stalled", 0, 69_999, 0, None), ("last", 0, 0, 2, None), ("new", None, 0, 0, None)]
    rows += [("patient", 0, 50_000, 0, 50_000), ("hasty", 0, 99_000, 0, 500)]
    df = spark.createDataFrame(rows, "id string, started_at bigint, heartbeat_at bigint, stall_count int, stall_timeout bigint")
    got = {r.id: r.a for r in df.select("id", P.stall_action(100_000).alias("a")).collect()}
    want = {"grace": "keep", "quiet": "keep", "stalled": "retry", "last": "move_to_dlq", "new": "keep", "patient": "keep", "hasty": "retry"}
    assert got == want


def test_ready_order(spark):
    rows = [job("a", run_at=2), job("b", run_at=1), job("c", lifo=True), job("d", lifo=True), job("e", priority=5, run_at=9)]
    assert values(spark.createDataFrame(rows, JOB).orderBy(*O.ready_order()), "id") == ["e", "d", "c", "b", "a"]


def test_prioritized_page(spark):
    rows = [job(f"n{i:02d}", created_at=i) for i in range(20)] + [job(f"p{i}", priority=10, created_at=30 + i) for i in range(5)]
    df = O.list_jobs(spark.createDataFrame(rows, JOB), ["prioritized"], 100, 0, 10)
    assert values(df, "id") == ["p0", "p1", "p2", "p3", "p4"]


def groups(spark, limit=None):
    rows = [("A", False, limit, None, 0, None), ("B", False, limit, None, 0, None)]
    return spark.createDataFrame(rows, "group_id string, paused boolean, concurrency_limit int, rate_limit int, rate_count int, last_served int")


def test_grouped_claim_goes_round(spark):
    rows = [job("plain")] + [job(i, group=i[0], order=n) for n, i in enumerate(["A1", "A2", "B1", "B2"])]
    none = spark.createDataFrame([], "job_id string")
    got = M.pull(spark.createDataFrame(rows, JOB), none, groups(spark), 10, 5)
    assert {r.id: r.source for r in got.collect()} == {"plain": 0, "A1": 1, "B1": 1, "A2": 1, "B2": 1}
    two = J.claim_grouped(spark.createDataFrame(rows, JOB), none, groups(spark), 10, 2)
    assert values(two, "id") == ["A1", "B1"]
    one_each = J.claim_grouped(spark.createDataFrame(rows, JOB), none, groups(spark, 1), 10, 10, 1)
    assert values(one_each, "id") == ["A1", "B1"]


EVENT = "queue string, event_type string, terminal boolean, occurred_at bigint"


def test_metric_series(spark):
    rows = [("q", "completed", True, m * 60000) for m in (0, 0, 1, 3)] + [("q", "failed", True, 120000)] * 2
    rows.append(("q", "failed", False, 0))
    buckets = A.minute_buckets(spark.createDataFrame(rows, EVENT))
    series = A.dense_series(buckets, 100).where("event_type = 'completed'")
    assert values(series.orderBy("position"), "n") == [1, 0, 1, 2]
    assert values(A.series_page(series, 0, 1).orderBy("position"), "n") == [1, 0]
    assert values(A.series_page(series, 2, -1).orderBy("position"), "n") == [1, 2]
    total = {r.event_type: (r.total, r.prev_minute, r.prev_n) for r in A.totals(buckets).collect()}
    assert total == {"completed": (4, 3, 1), "failed": (2, 2, 2)}
    assert A.retained(buckets, 2).where("event_type = 'completed'").count() == 1


def test_bucket_percentiles(spark):
    rows = [("k", 3.0)] * 50 + [("k", 8.0)] * 40 + [("k", 80.0)] * 10
    bounds = [1, 5, 10, 50, 100]
    h = A.histogram(spark.createDataFrame(rows, "k string, v double"), "k", "v", bounds)
    row = h.select(A.bucket_percentile(50, bounds).alias("a"), A.bucket_percentile(95, bounds).alias("b")).first()
    assert (row.a, row.b) == (5.0, 100.0)


def test_smoothed_rate(spark):
    rows = [("k", 0, 0), ("k", 1000, 10), ("k", 1050, 5), ("k", 2000, 15)]
    df = A.smoothed_rate(spark.createDataFrame(rows, "k string, at bigint, n bigint"), "k", "at", "n")
    assert df.first().rate == 13.0  # 10, then 0.3 * 20 + 0.7 * 10; what came 50 ms after waits


def test_fail_splits(spark):
    rows = [job("a", state="active"), job("b", state="active", attempts=2), job("c", state="active"), job("d")]
    fails = [("a", False, False), ("b", False, False), ("c", True, True)]
    out = M.fail(spark.createDataFrame(rows, JOB), spark.createDataFrame(fails, "id string, unrecoverable boolean, remove boolean"), 1000)
    assert {k: values(v, "id") for k, v in out.items()} == {"retry": ["a"], "dlq": ["b"], "remove": ["c"], "rest": ["d"]}
    assert out["retry"].first().run_at == 1000 + 2000


def test_admit(spark):
    jobs = spark.createDataFrame([("x", "pending", "c1", "u1"), ("y", "completed", "c2", "u2")], "id string, stored_state string, custom_id string, unique_key string")
    new = [("n1", "c1", None, 0), ("n2", None, "u1", 1), ("n3", None, "u2", 2), ("n4", None, "u2", 3), ("n5", None, None, 4)]
    got = M.admit(jobs, spark.createDataFrame(new, "id string, custom_id string, unique_key string, ordinal int"))
    assert sorted(values(got, "id")) == ["n3", "n5"]


def test_capacity():
    assert M.capacity(10, 3, 5, None) == 2
    assert M.capacity(10, 9, 5, None) == 0
    assert M.capacity(10, 0, None, 4) == 4


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted(values(G.reachable(edges, start), "node")) == ["a", "b", "c", "d"]
    levels, rest = G.peel(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string"))
    assert {r.node: r.level for r in levels.collect()} == {"a": 0, "b": 1, "c": 2}
    assert rest.count() == 0
    assert G.peel(edges)[1].count() == 4
    kids = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "id string")
    needs = spark.createDataFrame([("out", "k1"), ("k1", "k2"), ("p", "k0")], "job_id string, dependency_id string")
    assert values(G.removable(kids, needs), "id") == ["k3"]


def test_policies():
    def decisions(policy, times):
        state, out = (), []
        for t in times:
            made, state = policy(state, t)
            out.append(made)
        return out

    assert decisions(T.dedup(10), [0, 9, 10]) == ["new", "duplicate", "new"]
    assert decisions(T.dedup(10, "extend"), [0, 9, 18, 28]) == ["new", "extended", "extended", "new"]
    assert decisions(T.fixed_window(2, 10), [0, 1, 9, 10]) == ["allowed", "allowed", "limited", "allowed"]
    assert decisions(T.sliding_log(2, 10), [0, 5, 9, 10, 14, 15]) == ["allowed", "allowed", "limited", "allowed", "limited", "allowed"]
    assert decisions(T.token_bucket(2, 1), [0, 0, 0, 1000, 1500]) == ["allowed", "allowed", "limited", "allowed", "limited"]
    assert decisions(T.two_sweeps(10), [5, -15, -16, -17, 18, -40]) == ["beat", "live", "candidate", "stalled", "beat", "candidate"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i, i * 4) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id bigint, at bigint").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = T.run_stream(stream, "k", "at", T.dedup(30), 3_600_000)
    query = out.writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.decision for r in spark.table("decided").collect()}
    assert got == {r.id: r.decision for r in T.run_batch(df, "k", "at", T.dedup(30)).collect()}


@pytest.mark.parametrize(
    ("expression", "after", "zone", "want"),
    [
        ("0 9 * * *", "2024-01-15T00:00:00", "America/New_York", "2024-01-15T14:00:00"),
        ("0 9 * * *", "2024-07-15T00:00:00", "America/New_York", "2024-07-15T13:00:00"),
        ("30 30 2 * * *", "2024-03-30T12:00:00", "Europe/Rome", "2024-03-31T01:30:30"),
        ("30 30 1 * * *", "2024-11-02T12:00:00", "America/New_York", "2024-11-03T05:30:30"),
        ("*/15 * * * *", "2024-01-01T00:15:00", None, "2024-01-01T00:30:00"),
    ],
)
def test_cron(expression, after, zone, want):
    from datetime import UTC, datetime

    ms = lambda x: int(datetime.fromisoformat(x).replace(tzinfo=UTC).timestamp() * 1000)
    assert cron.next_run(expression, ms(after), zone) == ms(want)


def test_cron_text():
    assert cron.describe("0 9 * * *") == "every day at 09:00"
    with pytest.raises(ValueError):
        cron.parsed("61 * * * *")


def test_processors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    calls = D.wrapped(lambda job: job["n"], [lambda job, go: go(job) + 1, lambda job, go: go(job) * 10])
    got = D.process_each(df, calls)
    assert {r.id: r.result for r in got.collect()} == {"a": "11", "b": "21"}
    failed = D.process_each(df, lambda job: 1 / 0, tries=2)
    assert {r.error for r in failed.collect()} == {"division by zero"}
    assert sorted(values(D.process_batches(df, lambda jobs: [len(jobs)] * len(jobs), 1), "result")) == ["1", "1"]


def test_scalars(spark):
    row = spark.range(1).select(
        X.server_backoff(F.lit("exponential"), F.lit(1000), F.lit(20)).alias("capped"),
        X.client_backoff(F.lit("fibonacci"), F.lit(5), F.lit(10)).alias("fib"),
        X.next_interval_run(F.lit(None).cast("bigint"), F.lit(10).cast("bigint"), 100, F.lit(None).cast("bigint"), F.lit(None).cast("bigint")).alias("first"),
        X.next_interval_run(F.lit(50).cast("bigint"), F.lit(10).cast("bigint"), 100, F.lit(None).cast("bigint"), F.lit(None).cast("bigint")).alias("late"),
        X.stack_lines(F.lit(" a \n\n b\nc"), 2).alias("stack"),
        X.last_lines(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("tail"),
    ).first()
    assert (row.capped, row.fib, row.first, row.late) == (3_600_000.0, 80.0, 110, 110)
    assert (row.stack, row.tail) == (["a", "b"], ["b", "c"])


def test_nodes_on_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("x", "a"), ("f", "y"), ("s", "s"), ("p", "q")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert sorted(values(G.on_cycles(edges), "node")) == ["a", "b", "c", "e", "f", "s"]
    assert G.on_cycles(spark.createDataFrame([("p", "q")], "src string, dst string")).count() == 0


def test_flows_are_admitted_whole_or_not(spark):
    nodes = [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (4, "old"), (5, "t"), (5, "t"), (6, "f")]
    edges = [(1, "a", "b"), (2, "c", "d"), (2, "d", "c"), (3, "e", "nowhere"), (6, "f", "old")]
    got = M.flow_outcomes(
        spark.createDataFrame([("old",)], "id string"),
        spark.createDataFrame(nodes, "flow int, id string"),
        spark.createDataFrame(edges, "flow int, src string, dst string"),
    )
    want = {1: "accepted", 2: "cycle", 3: "unknown_dependency", 4: "existing_id", 5: "existing_id", 6: "accepted"}
    assert {r.flow: r.outcome for r in got.collect()} == want


def test_batch_keeps_its_prefix_and_replacing_rows_supersede(spark):
    jobs = spark.createDataFrame([("active", "k1"), ("pending", "k2"), ("completed", "k3")], "stored_state string, unique_key string")
    rows = [
        ("a", "k3", 1, False, False), ("b", "k3", 2, True, False), ("c", "k3", 3, False, False), ("d", None, 4, False, False),
        ("e", "k1", 5, True, False), ("f", "k2", 6, False, False), ("g", "k2", 7, True, False), ("bad", "z", 8, False, True), ("h", "w", 9, False, False),
    ]
    batch = spark.createDataFrame(rows, "id string, unique_key string, ordinal int, replaces boolean, invalid boolean")
    assert sorted(values(M.admit_batch(jobs, batch), "id")) == ["b", "d", "g"]


def test_cron_tick_outcomes(spark):
    rows = [
        ("gone", "q", None, None, 60_000, 10, 4, 4, None, False), ("lonely", "none", None, None, 60_000, 10, 0, None, None, True),
        ("again", "q", None, None, 60_000, 10, 0, None, 99_000, False), ("runs", "q", None, None, 60_000, 10, 0, None, 40_000, False),
        ("clock", "q", "* * * * *", None, None, 10, 0, None, None, False), ("odd", "q", "no cron", None, None, 10, 0, None, None, False),
        ("later", "q", None, None, 60_000, 200_000, 0, None, None, False),
    ]
    kinds = "name string, queue string, schedule string, zone string, repeat_every bigint, next_run bigint, executions int, max_limit int, last_fired bigint, skip_without_worker boolean"
    got = M.cron_tick(spark.createDataFrame(rows, kinds), spark.createDataFrame([("q",)], "queue string"), 100_000)
    assert {r.name: (r.outcome, r.executions, r.next_run) for r in got.collect()} == {
        "gone": ("removed", 4, None), "lonely": ("no-worker", 0, 120_010), "again": ("overlap", 0, 120_010),
        "runs": ("fired", 1, 120_010), "clock": ("fired", 1, 120_000), "odd": ("fired", 1, None),
    }


def test_alerts_and_owned_keys():
    def run(policy, events):
        state, out = (), []
        for e in events:
            made, state = policy(state, *e)
            out.append(made)
        return out

    assert run(T.lasting(10), [(1,), (5,), (11,), (12,), (-13,), (14,), (30,)]) == ["holds", "holds", "alert", "holds", "ended", "holds", "alert"]
    events = [(0, "gone"), (5, "queued"), (6, "active"), (30, "queued")]
    assert run(T.dedup_owned(20, "extend"), events) == ["new", "extended", "error", "new"]
    assert run(T.dedup_owned(20, "replace"), events) == ["new", "replaced", "behind_active", "new"]
    assert run(T.dedup_owned(20), events) == ["new", "duplicate", "duplicate", "new"]


def test_numbers_within_large_keys(spark):
    rows = [("a" if i % 9 else None, i) for i in range(400)]
    got = numbered(spark.createDataFrame(rows, "k string, i int").repartition(7), "k", [F.col("i")], "n").collect()
    for key in ("a", None):
        own = sorted((r.n, r.i) for r in got if r.k == key)
        assert own == list(enumerate(sorted(i for k, i in rows if k == key), 1))


def test_schedules_that_cannot_be_read_give_null(spark):
    rows = [(None, None), ("61 * * * *", None), ("* * * * *", "No/Where"), ("* * * * *", None)]
    frame = spark.createDataFrame(rows, "s string, z string").select(
        cron.cron_next("s", F.lit(0).cast("bigint"), "z").alias("at"), cron.cron_error("s", "z").alias("error"), cron.cron_text("s").alias("text")
    )
    got = frame.collect()
    assert [r.at for r in got] == [None, None, None, 60_000] and [r.error is None for r in got] == [False, False, False, True]


def test_timeline_is_full_at_twenty(spark):
    full = spark.range(1).select(X.timeline_append(F.array_repeat(F.lit("x"), 20), F.lit("y")).alias("a"), X.timeline_append(F.array(F.lit("x")), F.lit("y")).alias("b")).first()
    assert full.a == ["x"] * 20 and full.b == ["x", "y"]
