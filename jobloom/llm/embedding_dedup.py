"""Embedding near-duplicates: sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.components import connected_components
from jobloom.llm.hot_keys import attached
from jobloom.llm.storage import cut
from jobloom.llm.tiling import contracted, tiles, whole_tiles

#: Sign patterns are made so long that unlike vectors come to so many a bucket, whatever the number of all.
PER_BUCKET = 128


def usable(vector: Column) -> Column:
    """True for a vector that has a direction: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, safe for very small and very large components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def tables_of(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the classes, and tables so that a pair at the threshold is found with the recall."""
    bits = min(60, max(6, ceil(log2(max(classes, 1) / PER_BUCKET))))
    alike = (1 - acos(threshold) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - alike))) if alike < 1 else 1, bits


def signatures(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(rows, tables * bits) signs of random hyperplanes; the planes depend on seed and dimension only."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    return vectors @ planes > 0


def patterns(signs: np.ndarray, bits: int) -> np.ndarray:
    """(rows, tables) sign patterns as numbers."""
    return signs.reshape(len(signs), signs.shape[1] // bits, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _signed(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            widths = pc.list_value_length(vectors).to_numpy()
            out = np.zeros((batch.num_rows, tables * bits), dtype=bool)
            flat, ends = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(widths)))
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                block = flat[(ends[rows][:, None] + np.arange(width))]
                out[rows] = signatures(unit(block.astype(float)), tables, bits, seed)
            packed = pa.array([x.tobytes() for x in np.packbits(out, axis=1)], pa.binary())
            found = patterns(out, bits)
            sigs = pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, sigs], ["node", "copies", "vector", "signs", "sigs"])

    return run


def _roots(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each row over links (i, j)."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), dtype=np.int64)
    rank[order] = np.arange(len(node))
    i, j = rank[i], rank[j]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return node[order][label[rank]]


def _verified(threshold: float, tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, ["t", "dim", "sig"]):
            by = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("t", "dim", "sig", "tile_a", "tile_b")])
            edges = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            flat = {c: table.column(c).to_numpy() for c in ("node", "copies", "part")}
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2:
                    continue
                part, t, dim = flat["part"][a:b], int(by[0, a]), int(by[1, a])
                node, copies = flat["node"][a:b], flat["copies"][a:b]
                cells = table.slice(a, b - a)
                vectors = unit(cells.column("vector").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim))
                signs = np.frombuffer(b"".join(cells.column("signs").to_pylist()), np.uint8).reshape(b - a, -1)
                sigs = patterns(np.unpackbits(signs, axis=1, count=tables * bits), bits)
                left = np.flatnonzero(part == by[3, a])
                cross = by[3, a] != by[4, a]
                right = np.flatnonzero(part == by[4, a]) if cross else left
                found_i, found_j = [], []
                for at in range(0, len(left), 1024):
                    i, j = np.nonzero(vectors[left[at : at + 1024]] @ vectors[right].T >= threshold)
                    i, j = left[i + at], right[j]
                    if not cross:
                        i, j = i[i < j], j[i < j]
                    for earlier in range(t):
                        # A pair that also met in an earlier table is counted there.
                        apart = sigs[i, earlier] != sigs[j, earlier]
                        i, j = i[apart], j[apart]
                    found_i.append(i)
                    found_j.append(j)
                i, j = np.concatenate(found_i), np.concatenate(found_j)
                if not len(i):
                    continue
                n_links = np.bincount(i, copies[j], b - a) + np.bincount(j, copies[i], b - a)
                roots = _roots(node, i, j)
                rows = np.flatnonzero(n_links)
                cols = [node[rows], roots[rows], n_links[rows].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["node", "root", "links"])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    recall: float = 0.99,
    chunk: int = 1024,
    seed: int = 20,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Two rows are linked when their cosine, in double precision, is at least threshold; candidates share a sign pattern
    in one of the tables, so a pair exactly at the threshold is found with probability `recall` and closer pairs with
    more; the patterns' length follows the number of different vectors. Equal vectors are compared once, as a class
    with a count. A pair that meets in several tables counts in the first alone, so n_links is exact over the pairs
    found. Buckets are dealt to tiles of about chunk vectors and a tile returns counts and a spanning star, never its
    pairs. Classes have numbers of their own: ids may be of any type, null or repeated.

    Vectors that are null, empty, all zero, or hold a null or non-finite component link with nothing: n_links 0 and
    their own id as component. Vectors of different dimension are never linked. Repeated rows count as other vectors.
    A null id is kept and gets the smallest id reachable, null if there is none. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    tables, bits = tables_of(classes.count(), threshold, recall)
    kind = classes.schema["vector"].dataType.simpleString()
    signed = classes.select("node", "copies", "vector").mapInArrow(
        _signed(tables, bits, seed), f"node bigint, copies bigint, vector {kind}, signs binary, sigs array<bigint>"
    )
    dealt = signed.select(
        "node", "copies", "vector", "signs", F.size("vector").alias("dim"), F.posexplode("sigs").alias("t", "sig")
    )
    found = tiles(dealt, ["t", "dim", "sig"], "node", chunk).mapInArrow(
        _verified(threshold, tables, bits), "node bigint, root bigint, links bigint"
    )
    found = cut(found)
    grouped = connected_components(contracted(found, "node", "root"), "node", "root")
    members = grouped.join(classes.select("node", "least_id"), "node")
    named = cut(members.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    placed = attached(grouped, named, "component", "n").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = classes.join(counts, "node", "left").join(placed, "node", "left")
    whole = cut(
        whole.select(
            "vector",
            F.coalesce("component_id", "least_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "copies",
        )
    )
    alone = rows.where("vector is null").select(
        F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    linked = attached(rows.where("vector is not null"), whole, "vector", "copies")
    out = linked.select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def all_pairs_sql(threshold: float = 0.9) -> str:
    """The rows of all pairs of equal dimension, in SQL, for small tables: tables may miss a pair, this doesn't."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fine AS (SELECT row, vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda y: y * y)))) AS x FROM v
         WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.row AS a, b.row AS b, b.vec_id FROM fine a JOIN fine b ON a.row <> b.row AND len(a.x) = len(b.x)
          WHERE list_inner_product(a.x, b.x) >= {threshold}),
reached AS (SELECT row AS a, row AS b FROM fine UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
least AS (SELECT a, min(vec_id) AS component_id FROM reached JOIN fine ON fine.row = reached.b GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN least ON least.a = v.row LEFT JOIN counts ON counts.a = v.row"""
