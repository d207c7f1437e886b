"""Graph loops compute what they are given once, not once a round."""

from pathlib import Path
from urllib.parse import urlparse

from jobloom.operators import graph as G
from jobloom.operators import lifecycle as M


def counted(spark, rows, schema):
    """The rows as a DataFrame, and an accumulator of how many rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), seen


CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(6)]


def test_reachable_reads_its_edges_once(spark):
    edges, seen = counted(spark, CHAIN, "src string, dst string")
    got = G.reachable(edges, spark.createDataFrame([("n0",), ("n4",)], "node string"))
    assert got.count() == 8
    assert seen.value == len(CHAIN)


def test_admitted_edges_reads_its_edges_once(spark):
    edges, seen = counted(spark, CHAIN, "src string, dst string")
    new, asked = counted(spark, [("n6", "n0"), ("n0", "n5"), ("x", "x"), ("y", "n0")], "src string, dst string")
    assert sorted(tuple(r) for r in G.admitted_edges(edges, new).collect()) == [("n0", "n5"), ("y", "n0")]
    assert (seen.value, asked.value) == (len(CHAIN), 4)


def test_flows_of_long_chains_take_no_rounds(spark):
    n = 9
    chain = [(flow, f"{flow}:{i}", f"{flow}:{i + 1}") for flow in range(1, 5) for i in range(n)]
    edges = chain + [(2, f"2:{n}", "2:0"), (3, "3:4", "3:4"), (4, "4:0", "4:5")]
    nodes = [(flow, f"{flow}:{i}") for flow in range(1, 5) for i in range(n + 1)]
    G.kept(spark.range(1))
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = len(list(folder.iterdir()))
    got = M.flow_outcomes(
        spark.createDataFrame([("old",)], "id string"),
        spark.createDataFrame(nodes, "flow bigint, id string"),
        spark.createDataFrame(edges, "flow bigint, src string, dst string"),
    )
    assert {r.flow: r.outcome for r in got.collect()} == {1: "accepted", 2: "cycle", 3: "cycle", 4: "accepted"}
    assert len(list(folder.iterdir())) <= before + 1


def test_large_flows_are_trimmed_by_joins(spark):
    pairs = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "b"), (2, "c", "b"), (3, "a", "b"), (3, "b", "a"), (3, "x", None), (4, "z", "z"), (5, "q", "r")]
    edges = spark.createDataFrame(pairs, "flow int, src string, dst string")
    for most in (0, 2, 100):
        assert sorted(r.flow for r in G.cyclic_flows(edges, most).collect()) == [1, 3, 4]
