"""Reachability and order in dependency graphs (J13 to J17, G1 to G4). Rounds are written to the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
#: So many tables of earlier rounds stand beside each other before they are written as one.
PARTS = 12
#: Flows of more edges than this are trimmed by joins, smaller ones each within a task.
FLOW_EDGES = 1_000


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir; on one machine, where that is unset, to a temporary one."""
    _folder(df)
    return df.checkpoint()


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="jobloom-checkpoint-"))
    return str(context.getCheckpointDir())


def written(df: DataFrame) -> DataFrame:
    """df, written as a compressed table to the folder in spark.checkpoint.dir: computed once, where a checkpoint computes its last stage twice."""
    path = f"{_folder(df)}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grown(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """first and all that repeated steps from what is new add to it; each round writes its new rows only."""
    front = written(first.distinct())
    seen, parts = front, 1
    while not front.isEmpty():
        front = written(step(front).distinct().join(seen, keys, "left_anti"))
        seen, parts = seen.unionByName(front), parts + 1
        if parts > PARTS:
            seen, parts = written(seen), 1
    return seen


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): all nodes that each start reaches over (src, dst), cycles allowed.

    The edges are computed once, before the rounds.
    """
    edges = written(edges.select("src", "dst"))
    first = starts.select(c("node").alias("start")).join(edges, c("start") == c("src")).select("start", c("dst").alias("node"))
    return _grown(first, lambda front: front.join(edges, c("node") == c("src")).select("start", c("dst").alias("node")), ["start", "node"])


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): starts and all nodes that any of them reaches, each once."""
    return _reached(written(edges.select("src", "dst")), starts)


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return _grown(
        starts.select("node"), lambda front: front.join(edges, c("node") == c("src")).select(c("dst").alias("node")), ["node"]
    )


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(c("dst").alias("src"), c("src").alias("dst"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): the nodes that lie on a cycle over (src, dst).

    What no topological level takes from either side is left. There each node takes the greatest node that reaches it
    as its colour; the nodes that reach back to their colour's node lie on cycles with it. They and the colours' nodes
    go, and what is left is trimmed and coloured again. Every step keeps a row a node, never pairs of nodes.
    """
    rest = _core(edges)
    found: DataFrame | None = None
    while not rest.isEmpty():
        colours = _coloured(rest)
        own = rest.join(colours.select(c("node").alias("src"), "colour"), "src")
        own = own.join(colours.select(c("node").alias("dst"), c("colour").alias("dst_colour")), "dst").where("colour = dst_colour")
        own = written(own.select("src", "dst", "colour"))
        ends = own.where("dst = colour").select(c("src").alias("node"))
        back = written(_grown(ends, lambda front, e=own: front.join(turned(e), c("node") == c("src")).select(c("dst").alias("node")), ["node"]))
        found = back if found is None else found.unionByName(back)
        gone = back.union(colours.select("colour")).distinct()
        inside = rest.join(gone.select(c("node").alias("src")), "src", "left_anti").join(gone.select(c("node").alias("dst")), "dst", "left_anti")
        rest = _core(inside.select("src", "dst"))
    return edges.select(c("src").alias("node")).limit(0) if found is None else found.distinct()


def _core(edges: DataFrame) -> DataFrame:
    """Edges that no topological level takes from the front or from the back; each round takes a level from both sides."""
    rest = written(edges.select("src", "dst").distinct())
    n = rest.count()
    while n:
        led_to, leading = rest.select(c("dst").alias("src")).distinct(), rest.select(c("src").alias("dst")).distinct()
        rest, before = written(rest.join(led_to, "src", "left_semi").join(leading, "dst", "left_semi").select("src", "dst")), n
        n = rest.count()
        if n == before:
            break
    return rest


def cyclic_flows(edges: DataFrame, most: int = FLOW_EDGES) -> DataFrame:
    """M3: (flow): the flows that have a cycle over their edges (flow, src, dst).

    Only flows in which some edge goes up and some down in the order of the ids can have one. Of those, the ones of at
    most so many edges are trimmed within tasks, all flows of a batch together, and larger ones by joins.
    """
    up, down = F.coalesce(c("src") <= c("dst"), F.lit(True)), F.coalesce(c("src") >= c("dst"), F.lit(True))
    sizes = edges.groupBy("flow").agg(F.count("*").alias("n"), F.bool_or(up).alias("up"), F.bool_or(down).alias("down"))
    turning = written(sizes.where("up and down").select("flow", "n"))
    small = edges.join(turning.where(c("n") <= most).select("flow"), "flow", "left_semi")
    gathered = small.groupBy("flow").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    found = gathered.mapInArrow(_with_cycle, edges.select("flow").schema)
    large = turning.where(c("n") > most).select("flow")
    if large.isEmpty():
        return found
    by_flow = [F.struct("flow", c(x).alias("id")).alias(x) for x in ("src", "dst")]
    rest = _core(edges.join(large, "flow", "left_semi").select(*by_flow))
    return found.unionByName(rest.select("src.flow").distinct())


def _with_cycle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (flow, edges), the flows of which trimming from both sides leaves edges."""
    for batch in batches:
        flows, lists = batch.column(0), batch.column(1)
        pairs = lists.flatten()
        ids = pa.concat_arrays([pairs.field("src"), pairs.field("dst")]).dictionary_encode("encode")
        row = np.repeat(np.arange(len(flows)), np.diff(lists.offsets.to_numpy()))
        names = np.tile(row, 2) * max(len(ids.dictionary), 1) + ids.indices.to_numpy()
        src, dst = np.unique(names, return_inverse=True)[1].reshape(2, -1)
        while len(src):
            stays = np.isin(src, dst) & np.isin(dst, src)
            if stays.all():
                break
            src, dst, row = src[stays], dst[stays], row[stays]
        yield pa.RecordBatch.from_arrays([flows.take(pa.array(np.unique(row)))], ["flow"])


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each, itself included."""
    now = written(edges.select(c("src").alias("node")).union(edges.select(c("dst").alias("node"))).distinct().withColumn("colour", c("node")))
    while True:
        sent = edges.join(now, c("src") == c("node")).select(c("dst").alias("node"), "colour")
        after = written(now.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")))
        if after.join(now, ["node", "colour"], "left_anti").isEmpty():
            return after
        now = after


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topological levels (node, level) and the edges that no level takes, those on or behind cycles.

    Each round takes the nodes to which no edge leads any more, as Kahn's rule does, a whole level at a time.
    """
    rest = kept(edges.select("src", "dst").distinct())
    nodes = rest.select(c("src").alias("node")).union(rest.select(c("dst").alias("node"))).distinct()
    left = kept(nodes)
    levels: DataFrame | None = None
    level = 0
    while True:
        free = kept(left.join(rest.select(c("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        levels = free if levels is None else levels.unionByName(free)
        rest = kept(rest.join(free.select(c("node").alias("src")), "src", "left_anti"))
        left = kept(left.join(free, "node", "left_anti"))
        level += 1
    if levels is None:
        levels = left.withColumn("level", F.lit(0)).limit(0)
    return levels, rest


def asymmetric(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Edges (src, dst) that one side lists and the other doesn't."""
    by = ["src", "dst"]
    return parents.join(children, by, "left_anti").withColumn("side", F.lit("parent")).unionByName(
        children.join(parents, by, "left_anti").withColumn("side", F.lit("child"))
    )


def tree(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> DataFrame:
    """(root, node, depth) down to a depth, at most so many children of a node (by id) and no node twice on a path."""
    by = Window.partitionBy("src").orderBy("dst")
    narrow = edges.withColumn("n", F.row_number().over(by)).where(c("n") <= most).select("src", "dst")
    level = roots.select(c("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    whole = level
    for d in range(1, depth + 1):
        level = (
            level.join(narrow, c("node") == c("src"))
            .where(~F.array_contains("path", c("dst")))
            .select("root", c("dst").alias("node"), F.lit(d).alias("depth"), F.array_append("path", c("dst")).alias("path"))
        )
        whole = whole.unionByName(level)
    return whole.select("root", "node", "depth")


def removable(children: DataFrame, edges: DataFrame) -> DataFrame:
    """Children (id) that can go, as nothing that stays needs them.

    edges (job_id, dependency_id). A child that a job outside the set needs stays, and so does what it needs in turn.
    """
    own = written(children.select(c("id").alias("node")).distinct())
    arrows = edges.select(c("job_id").alias("src"), c("dependency_id").alias("dst")).join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    arrows = written(arrows.select("src", "dst"))
    outside = arrows.join(own.withColumnRenamed("node", "src"), "src", "left_anti").select(c("dst").alias("node"))
    return own.join(_reached(arrows, outside), "node", "left_anti").select(c("node").alias("id"))


def chain_edges(steps: DataFrame, chain: str, order: str, node: str) -> DataFrame:
    """Each step depends on the one before it in its chain."""
    before = F.lag(node).over(Window.partitionBy(chain).orderBy(order))
    return steps.withColumn("src", before).where("src is not null").select("src", c(node).alias("dst"))


def fan_in_edges(steps: DataFrame, final: str) -> DataFrame:
    """One final job depends on every step."""
    return steps.select(c("node").alias("src"), F.lit(final).alias("dst"))


def admitted_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges (src, dst) that close no cycle over the existing ones: those whose dst does not reach src.

    Pairs are followed only over edges that lie both behind some new dst and before some new src.
    """
    edges, new = written(edges.select("src", "dst")), written(new)
    behind = _reached(edges, new.select(c("dst").alias("node")).distinct())
    before = _reached(turned(edges), new.select(c("src").alias("node")).distinct())
    both = written(behind.join(before, "node", "left_semi"))
    near = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")
    starts = new.select(c("dst").alias("node")).distinct()
    back = reachable(near, starts).select(c("start").alias("dst"), c("node").alias("src"))
    return new.where("src <> dst").join(back, ["src", "dst"], "left_anti")


def tree_edges(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Parent to child; children run first in a flow, so the edge is a dependency of the parent."""
    return parents.where(c(parent).isNotNull()).select(c(parent).alias("src"), c(node).alias("dst"))
