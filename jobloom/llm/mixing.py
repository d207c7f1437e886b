"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded order that one round of the cut search resolves, and all its bits.
STEP, ORDER_BITS = 10, 60
#: Columns of the result; columns of documents of these names give way to them.
RESULTS = ["mix_size", "mix_taken", "mix_source_size", "mix_target"]
#: So many different sets of sources are planned at most.
MOST_PATTERNS = 65_536


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def share_targets(weights: Sequence[float], limits: Sequence[float], total: float) -> list[float]:
    """Split total by weight; what stands above a limit stops there and is reshared until none is above."""
    targets = [0.0] * len(weights)
    free = set(range(len(weights)))
    rest = float(total)
    while free:
        mass = sum(weights[i] for i in sorted(free))
        shares = {i: rest * weights[i] / mass for i in sorted(free)}
        above = [i for i in sorted(free) if shares[i] > limits[i]]
        if not above:
            for i, x in shares.items():
                targets[i] = x
            break
        for i in above:
            targets[i] = float(limits[i])
            rest -= limits[i]
            free.discard(i)
    return targets


class Flow:
    """Shortest augmenting paths on a small graph."""

    def __init__(self):
        self.arcs: dict[object, dict[object, int]] = {}

    def add(self, a, b, room: int) -> None:
        self.arcs.setdefault(a, {}).setdefault(b, 0)
        self.arcs.setdefault(b, {}).setdefault(a, 0)
        self.arcs[a][b] += room

    def push(self, start, end) -> int:
        total = 0
        while True:
            came, queue = {start: None}, deque([start])
            while queue and end not in came:
                a = queue.popleft()
                for b, room in self.arcs.get(a, {}).items():
                    if room > 0 and b not in came:
                        came[b] = a
                        queue.append(b)
            if end not in came:
                return total
            path, b = [], end
            while came[b] is not None:
                path.append((came[b], b))
                b = came[b]
            most = min(self.arcs[a][b] for a, b in path)
            for a, b in path:
                self.arcs[a][b] -= most
                self.arcs[b][a] += most
            total += most


def route(tokens: dict[str, int], members: dict[str, list], quotas: dict[object, int], repeats: int) -> dict[str, dict]:
    """Tokens that each pattern gives to each of its sources: {pattern: {source: tokens}}.

    Each use of a pattern's tokens costs one more than the last, so the cheapest flow is found by letting in one use
    after another and augmenting: a path of the higher cost is taken only when none of the lower is left.
    """
    flow = Flow()
    for pattern in sorted(tokens):
        for source in members[pattern]:
            flow.add(("pattern", pattern), ("source", source), repeats * tokens[pattern])
    for source in quotas:
        flow.add(("source", source), "end", quotas[source])
    for _ in range(repeats):
        for pattern in sorted(tokens):
            flow.add("start", ("pattern", pattern), tokens[pattern])
        flow.push("start", "end")
    return {
        p: {s: flow.arcs[("source", s)][("pattern", p)] for s in members[p] if flow.arcs[("source", s)][("pattern", p)]}
        for p in tokens
    }


def _cuts(sized: DataFrame, rests: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Where each pattern's seeded order is cut: {pattern: (cut, rest at the cut, size at the cut)}.

    Sizes are summed by bins of the order; each round looks into the one bin where a pattern's rest runs out. A round
    aggregates by (pattern, bin) and brings one row a pattern to the driver.
    """
    spark = sized.sparkSession
    state = {p: (0, rest) for p, rest in rests.items() if rest > 0}
    done: dict[str, tuple[int, int, int]] = {}
    for shift in range(ORDER_BITS - STEP, -1, -STEP):
        if not state:
            break
        rows = [(p, prefix, rest) for p, (prefix, rest) in state.items()]
        wanted = spark.createDataFrame(rows, "pattern string, prefix bigint, rest bigint")
        near = sized.join(F.broadcast(wanted), "pattern").where(
            F.shiftright("place", shift + STEP) == F.col("prefix")
        )
        bins = near.groupBy("pattern", "rest", F.shiftright("place", shift).alias("bin")).agg(
            F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        upto = Window.partitionBy("pattern").orderBy("bin")
        ends = bins.withColumn("upto", F.sum("size").over(upto)).where("upto >= rest and upto - size < rest")
        state = {}
        for r in ends.collect():
            left = r.rest - (r.upto - r["size"])
            if r.low == r.high:
                done[r.pattern] = (r.low, left, r["size"])
            else:
                state[r.pattern] = (r.bin, left)
    return done


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    repeats: int = 2,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_documents: bool = False,
) -> DataFrame:
    """docs with mix_size, mix_taken and, for documents of one source, mix_source_size and mix_target.

    sources is an array of the sources a document belongs to. Sources in order of code point, null last, weigh weights
    in rotation and share total_share of all words; a target stops at repeats times its source's size and the excess
    is reshared. Documents are summed by membership pattern; a flow routes the patterns' words to the sources' quotas,
    where every further use of the same words costs more. A pattern then gives each of its documents the whole uses,
    and the rest to those first in an order seeded by (seed, id): the document at the cut gives only its part, or, with
    whole_documents, all or nothing, whichever is nearer. No document gives more than repeats times its size.

    The driver sees one row per pattern (as many as there are different sets of sources), never documents; more than
    MOST_PATTERNS of them, which 16 sources can't have, are an error, as nothing could be left out of the flow. Null and
    empty texts have size 0 and give nothing. Repeated rows of one id stand at one place of the order and share what
    is taken there. Equal tables give equal results. An empty table gives no rows.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array()))), {"ignoreNullFields": "false"})
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << ORDER_BITS))
    known = docs.drop(*RESULTS).withColumns({"mix_inner_pattern": pattern, "mix_size": word_count(F.col(text_col)), "mix_inner_place": place})
    sized = cut(
        known.select(
            F.col("mix_inner_pattern").alias("pattern"), F.col("mix_size").alias("size"), F.col("mix_inner_place").alias("place")
        )
    )
    sums = sized.groupBy("pattern").agg(F.sum("size").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"documents have more than {MOST_PATTERNS} different sets of sources: join sources first")
    tokens = {r.pattern: r.tokens for r in sums}
    members = {p: json.loads(p) for p in tokens}
    sizes: dict[str | None, int] = {}
    for p, n in tokens.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    limits = [repeats * sizes[s] for s in names]
    targets = share_targets(
        [weights[i % len(weights)] for i in range(len(names))], limits, total_share * sum(tokens.values())
    )
    quotas = {s: round(t) for s, t in zip(names, targets, strict=True)}
    routes = route(tokens, members, quotas, repeats)
    takes = {p: sum(x.values()) for p, x in routes.items()}
    whole = {p: takes[p] // n if n else 0 for p, n in tokens.items()}
    cuts = _cuts(sized, {p: takes[p] - whole[p] * n for p, n in tokens.items()})
    by_name = dict(zip(names, targets, strict=True))
    rows = []
    for p in tokens:
        at, rest, group = cuts.get(p, (-1, 0, 1))
        only = members[p][0] if len(members[p]) == 1 else ...
        own = (None, None) if only is ... else (sizes[only], by_name[only])
        rows.append((p, whole[p], at, rest, group, *own))
    plan = docs.sparkSession.createDataFrame(
        rows,
        "mix_plan_pattern string, mix_inner_whole bigint, mix_inner_at bigint, mix_inner_rest bigint, mix_inner_grouped bigint, "
        "mix_source_size bigint, mix_target double",
    )
    here = F.floor(F.col("mix_size") * F.col("mix_inner_rest") / F.col("mix_inner_grouped"))
    if whole_documents:
        here = F.when(2 * F.col("mix_inner_rest") >= F.col("mix_inner_grouped"), F.col("mix_size")).otherwise(0)
    before, at_cut = F.col("mix_inner_place") < F.col("mix_inner_at"), F.col("mix_inner_place") == F.col("mix_inner_at")
    further = F.when(before, F.col("mix_size")).when(at_cut, here)
    taken = (F.col("mix_inner_whole") * F.col("mix_size") + F.coalesce(further, F.lit(0))).cast("bigint")
    mixed = known.join(F.broadcast(plan), F.col("mix_inner_pattern") == F.col("mix_plan_pattern")).withColumn("mix_taken", taken)
    return mixed.select([n for n in docs.columns if n not in RESULTS] + RESULTS)
