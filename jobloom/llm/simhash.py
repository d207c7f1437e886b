"""SimHash near-duplicate groups with bit-sliced comparison inside candidate buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, count
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.bitslice import components, near_rows
from jobloom.llm.components import connected_components
from jobloom.llm.hot_keys import attached
from jobloom.llm.storage import cut
from jobloom.llm.tiling import contracted, tiles, whole_tiles

SEED = 42
#: Lanes gathered before small tiles are compared together.
LANES = 1 << 16
#: Keys are made so long that unlike fingerprints come to so many a bucket, whatever the number of all.
PER_BUCKET = 64

Keys = Callable[[np.ndarray], np.ndarray]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles in their order; fewer words than width are one shingle, no word none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=n)


def _spread(hashes: np.ndarray, part: int) -> np.ndarray:
    """Further hash values from the first ones, by a 64-bit finalizer; part 0 is the hashes themselves."""
    if not part:
        return hashes
    x = hashes + np.uint64((part * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """The fingerprint of hashes, in parts of 64 bits: a bit is set where more than half of them set it."""
    ones = np.zeros((parts, 64), dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        for p in range(parts):
            rows = _spread(hashes[at : at + 65536], p).view(np.uint8).reshape(-1, 8)
            ones[p] += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def lists(cells: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit values as one column."""
    ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
    flat = np.concatenate(cells) if cells else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id_col, fp): the 64-bit SimHash of each row's whole text, in an array of one; zero without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = lists([signs(shingle_hashes(t.as_py(), width)) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], [id_col, "fp"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return wanted.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp array<bigint>")


def masked_keys(radius: int, classes: int) -> Keys:
    """Keys of 64-bit fingerprints by masks: any two within radius agree wholly under at least one of them.

    The bits are cut into blocks, and each mask leaves out radius of them. More classes take more blocks, so longer
    keys; no pair is missed with any number of blocks.
    """
    blocks = radius + 1
    while blocks < 64 and 64 * (blocks - radius) / blocks < log2(max(classes, 1) / PER_BUCKET + 1):
        blocks += 1
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = np.array([sum(some) for some in combinations(pieces, blocks - radius)], dtype=np.uint64)
    return lambda fps: fps[:, :1] & masks[None, :]


def drawn_keys(parts: int, share: float, recall: float, classes: int) -> Keys:
    """Keys by bits drawn with a fixed seed, one in each of several tables.

    The bits grow with the logarithm of the classes, and the tables with them, so that one table at least joins two
    fingerprints whose bits differ with the given chance: over what their number of differing bits may be.
    """
    whole, bits = 64 * parts, min(60, max(8, ceil(log2(max(classes, 1) / (8 * PER_BUCKET)))))
    chance = np.array([comb(whole, k) * share**k * (1 - share) ** (whole - k) for k in range(whole + 1)])
    alike = np.array([comb(whole - k, bits) / comb(whole, bits) for k in range(whole + 1)])
    tables = next(n for n in count(1) if chance @ (1 - (1 - alike) ** n) >= recall)
    drawn = np.random.default_rng(17).permuted(np.tile(np.arange(64 * parts), (tables, 1)), axis=1)[:, :bits]

    def keys(fps: np.ndarray) -> np.ndarray:
        out = np.zeros((len(fps), tables), dtype=np.uint64)
        for k in range(bits):
            at = drawn[:, k]
            out |= ((fps[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)) << np.uint64(k)
        return out

    return keys


def _keyed(keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            found = keys(fps).view(np.int64)
            ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            cells = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "keys"])

    return run


def with_keys(classes: DataFrame, keys: Keys) -> DataFrame:
    """Rows of classes, which have a column fp, once for each table t, with their key k in it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    keyed = classes.mapInArrow(_keyed(keys), f"{kinds}, keys array<bigint>")
    return keyed.select(*classes.columns, F.posexplode("keys").alias("t", "k"))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def linked(groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            rows: dict[int, dict[int, np.ndarray]] = {}
            for g, r, mask in near_rows([fps for _, fps in groups], radius):
                rows.setdefault(g, {})[r] = mask
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for g, own in rows.items():
                for inside in components(own):
                    nodes = np.sort(groups[g][0][inside])
                    u.append(nodes[1:])
                    v.append(np.repeat(nodes[0], len(nodes) - 1))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], ["u", "v"])

        for table in whole_tiles(batches, ["t", "k"]):
            by = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("t", "k", "tile_a", "tile_b")])
            nodes = table.column("node").to_numpy()
            fps = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
            edges = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), len(nodes)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2:
                    continue
                size = 1 << max(3, (b - a - 1).bit_length())
                some = waiting.setdefault(size, [])
                some.append((nodes[a:b], fps[a:b]))
                if len(some) * max(64, size) >= LANES:
                    yield linked(waiting.pop(size))
        for groups in waiting.values():
            yield linked(groups)

    return run


def links(classes: DataFrame, keys: Keys, radius: int, chunk: int) -> DataFrame:
    """(u, v) links, u above v, that span the components of the pairs of (node, fp) with a common key within radius bits.

    A tile returns a spanning star of each group it finds, from its smallest node, not all its pairs; of a node's
    stars only its smallest centre is kept, and the others are linked to that.
    """
    rows = with_keys(classes.select("node", "fp"), keys)
    stars = tiles(rows, ["t", "k"], "node", chunk).mapInArrow(_compare(radius), "u bigint, v bigint")
    return contracted(stars, "u", "v")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    radius: int = 4,
    chunk: int = 1024,
) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs; fp is an array of one.

    64-bit fingerprints within radius bits are linked, and no such pair is missed; component_id is the smallest id
    reachable by links, the row's own included. Texts with equal fingerprints are compared once, as a class.

    Rows of equal texts have equal fingerprints and so one component; null and empty texts have fingerprint 0 and form
    (with whatever lies near 0) one component. Repeated rows are kept, each with the same result. A null id is
    returned as it is and never chosen as component_id unless no row of the component has an id. An empty table gives
    no rows. Other columns of docs are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    facts = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("copies"))
    classes = cut(facts.withColumn("node", F.col("fp")[0]))
    grouped = connected_components(links(classes, masked_keys(radius, classes.count()), radius, chunk), "u", "v")
    members = grouped.join(classes.select("node", "least_id"), "node")
    named = cut(members.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    placed = attached(grouped, named, "component", "n").select("node", "component_id")
    whole = classes.join(placed, "node", "left")
    whole = cut(whole.select("fp", F.coalesce("component_id", "least_id").alias("component_id"), "copies"))
    return attached(prints, whole, "fp", "copies").select(id_col, "fp", "component_id")
