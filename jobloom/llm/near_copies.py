"""Groups of texts whose word shingles are alike: candidates by wide SimHash fingerprints, decided on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.components import connected_components
from jobloom.llm.hot_keys import attached
from jobloom.llm.simhash import Keys, drawn_keys, links, lists, shingle_hashes, signs, with_keys
from jobloom.llm.storage import cut
from jobloom.llm.tiling import contracted, tiles, whole_tiles

#: Words of 64 bits in a fingerprint, and in the shortest parity sketch (a power of two).
PARTS, SKETCH = 4, 8
#: A text's partners are dealt to so many tasks.
DEALT = 32
#: So many wanted rows are sent to every task; beyond, they and the texts are shuffled.
BROADCAST_ROWS = 200_000
#: So many tables of keys are shuffled at a time, so that the disk in use does not grow with their number.
TABLES = 24
#: The table number of tiles that hold whole groups.
WHOLE = -1
#: Rounds in which each text meets its nearest partner; after them, what is undecided meets all its partners.
NEAREST_ROUNDS = 2


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes' buckets, two a hash or more: two sets differ in no fewer members than their sketches in bits."""
    words = max(SKETCH, 1 << (max(1, len(hashes) // 32) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer words: parities of the buckets that fall together."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def share_and_radius(least: Fraction) -> tuple[float, int]:
    """The share of bits in which fingerprints of sets at that similarity differ, and a radius that hardly any exceeds.

    Sets of Jaccard similarity j have a cosine of 2j / (1 + j) or more, and bits differ with the angle over pi. In
    small sets halves that tie flip a quarter more; the radius lies four deviations above that.
    """
    share = acos(2 * least / (1 + least)) / pi
    most = min(0.5, 1.25 * share)
    return share, ceil(64 * PARTS * most + 4 * sqrt(64 * PARTS * most * (1 - most)))


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            digests = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            cells = [digests, pa.array([len(s) for s in sets], pa.int64())]
            cells += [lists([signs(s, PARTS) for s in sets]), lists([sketch(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["row", "digest", "size", "fp", "sketch"])

    return run


def _decided(width: int, least: Fraction):
    """(u, v, alike) of each text u that follows its root v in the sorted rows (root, part, member, row, text)."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, centre = None, np.empty(0, np.uint64)
        for batch in batches:
            us, vs, alike = [], [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "part", "member", "row")), strict=True)
            for (root, part, member, row), text in zip(keys, batch.column("text"), strict=True):
                own = np.unique(shingle_hashes(text.as_py(), width))
                if not member:
                    here, centre = (root, part), own
                    continue
                assert here == (root, part), "a root comes before its members"
                shared = len(np.intersect1d(centre, own, assume_unique=True))
                us.append(row)
                vs.append(root)
                alike.append(shared * (p + q) >= p * (len(centre) + len(own)))
            cells = [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(alike, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, ["u", "v", "alike"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(u, v, alike) for pairs (u, v) of rows of texts (row, text): whether their whole shingle sets have the similarity.

    Each v, with its text, goes once to every task that holds some of its partners, DEALT at most.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(DEALT)).cast("int"))
    members = dealt.select(F.col("u").alias("row"), F.col("v").alias("root"), "part", F.lit(1).alias("member"))
    roots = dealt.select("v", "part").distinct().select(F.col("v").alias("row"), F.col("v").alias("root"), "part", F.lit(0).alias("member"))
    wanted = cut(members.unionByName(roots))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sent = texts.join(wanted, "row").select("root", "part", "member", "row", "text")
    by = sent.repartition("root", "part").sortWithinPartitions("root", "part", "member")
    return by.mapInArrow(_decided(width, least), "u bigint, v bigint, alike boolean")


def _met(least: Fraction, nearest: bool):
    """(u, v, far) pairs of a tile that stand in different components, were not tried, and that size and sketch allow.

    far is the share of the two sets' members by which their sketches say that they differ at least. With nearest, a
    row's pair of the smallest far alone.
    """
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, ["t", "k"]):
            by = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("t", "k", "tile_a", "tile_b")])
            node, comp, size = (table.column(c).to_numpy() for c in ("node", "comp", "size"))
            cells = table.column("sketch").combine_chunks()
            flat, ends = cells.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(cells.value_lengths().to_numpy())))
            whole = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            tried = table.column("tried").to_pylist()
            bits = np.stack([folded(x, SKETCH) for x in whole])
            edges = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), len(node)]
            us, vs, fars = [], [], []
            for a, b in zip(edges, edges[1:], strict=False):
                n, c, s, w = node[a:b], comp[a:b], size[a:b], bits[a:b]
                for at in range(0, b - a, 256):
                    own = slice(at, at + 256)
                    near = c[own, None] != c
                    if not nearest:
                        near &= n[own, None] > n
                    near &= q * np.minimum(s[own, None], s) >= p * np.maximum(s[own, None], s)
                    if not near.any():
                        continue
                    apart = np.zeros(near.shape, np.int64)
                    for j in range(SKETCH):
                        apart += np.bitwise_count(w[own, None, j] ^ w[None, :, j])
                    near &= apart * (p + q) <= (q - p) * (s[own, None] + s)
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        me, no = a + at + i, set(tried[a + at + i] or ())
                        js = np.array([j for j in np.flatnonzero(near[i]).tolist() if int(n[j]) not in no], np.int64)
                        far = apart[i, js]
                        for x in np.flatnonzero((s[js] > 32 * SKETCH) | (size[me] > 32 * SKETCH)).tolist():
                            one, two = whole[me], whole[a + int(js[x])]
                            words = min(len(one), len(two))
                            far[x] = int(np.bitwise_count(folded(one, words) ^ folded(two, words)).sum())
                        fits = far * (p + q) <= (q - p) * (size[me] + s[js])
                        js, far = js[fits], far[fits] / (size[me] + s[js[fits]])
                        if nearest and len(js):
                            best = np.lexsort((n[js], far))[:1]
                            js, far = js[best], far[best]
                        us.append(np.full(len(js), node[me]))
                        vs.append(n[js])
                        fars.append(far)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, fars)], ["u", "v", "far"])

    return run


def _open_members(near: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, comp, loose, n) of the nodes of near (node, component) whose component there, loose with n nodes, holds more than one of joined's."""
    placed = cut(
        near.withColumnRenamed("component", "loose")
        .join(joined, "node", "left")
        .select("node", "loose", F.coalesce("component", "node").alias("comp"))
    )
    loose = placed.groupBy("loose").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    return cut(attached(placed, loose, "loose", "n").where("a <> b").select("node", "comp", "loose", "n"))


def _partners(open_rows: DataFrame, classes: DataFrame, tried: DataFrame, keys: Keys, least: Fraction, nearest: bool, chunk: int) -> DataFrame:
    """Pairs (u, v), u above v, of candidates in different components.

    A group of chunk nodes at most meets whole in one tile, so each of its nodes is sent once, and all its pairs are
    candidates; the nodes of larger ones meet by keys.
    """
    again = tried.select("u", "v").unionByName(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
    again = again.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("tried"))
    rows = classes.select("node", "fp", "size", "sketch").join(open_rows, "node").join(again, "node", "left")
    facts = ["node", "comp", "size", "sketch", "tried"]
    whole = rows.where(F.col("n") <= chunk).select(*facts, F.lit(WHOLE).alias("t"), F.col("loose").alias("k"))
    keyed = with_keys(rows.where(F.col("n") > chunk).select(*facts, "fp"), keys).drop("fp")
    dealt = tiles(whole.unionByName(keyed), ["t", "k"], "node", chunk)
    met = dealt.mapInArrow(_met(least, nearest), "u bigint, v bigint, far double")
    if nearest:
        met = met.groupBy("u").agg(F.min(F.struct("far", "v")).alias("best")).select("u", "best.v")
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _linked(classes: DataFrame, keys: Keys, radius: int, chunk: int) -> DataFrame:
    """links of all tables of keys, TABLES of them at a time."""
    count = keys(np.zeros((1, PARTS), np.uint64)).shape[1]
    turns = ceil(count / TABLES)
    found = None
    for turn in range(turns):
        some = slice(count * turn // turns, count * (turn + 1) // turns)
        more = cut(links(classes, lambda fps, some=some: keys(fps)[:, some], radius, chunk))
        found = more if found is None else found.unionByName(more)
    return found if turns == 1 else cut(contracted(found, "u", "v"))


def _texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, text) of the classes that nodes (node) names, written; row is the node. Repeated rows give one."""
    wanted = cut(nodes.select("node").join(classes.select("node", "row", "copies"), "node"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sent = texts.join(wanted, "row").select(F.col("node").alias("row"), "text", "copies")
    several = sent.where("copies > 1").dropDuplicates(["row"])
    return cut(sent.where("copies = 1").unionByName(several).select("row", "text"))


def similar_groups(
    docs: DataFrame,
    row_col: str,
    text_col: str = "text",
    width: int = 5,
    least: str = "0.8",
    recall: float = 0.98,
    chunk: int = 1024,
) -> DataFrame:
    """(row_col, component) for every row of docs; rows of equal row_col, which is never null, must have equal texts.

    docs is read twice or three times, in whatever order of rows, and never copied: only texts with a candidate are
    written, once. row_col may have any type that has an order, structs too. Texts are linked whose sets of word shingles (ASCII letters lowered, words split at ASCII blanks) have a Jaccard
    similarity of at least `least`; component is the smallest row that links reach. Equal sets are one class.

    Candidates are pairs of 256-bit SimHash fingerprints of the sets that share a drawn key and lie within a radius: a
    pair at exactly that similarity is one with probability `recall` or so (less in sets of a few shingles), a closer
    one with more. Groups of candidates are then linked in rounds, and every link is decided on the two whole sets, so
    none rests on an estimate. First each text is tried with the smallest of its tile's group. In groups that this
    leaves in several components, each text is tried with its nearest candidate of another component by parity
    sketches, which never rule out a true pair; what is then still apart is tried with all candidates that sketches
    allow. So no candidate pair between two components is left undecided. In groups of chunk texts or fewer all pairs
    are candidates then, whether they share a key or not.

    Texts without a word are one component. Null texts count as empty. An empty table gives no rows.
    """
    at_least = Fraction(least)
    share, radius = share_and_radius(at_least)
    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["row"].dataType.simpleString()
    described = cut(
        texts.mapInArrow(_described(width), f"row {kind}, digest binary, size bigint, fp array<bigint>, sketch array<bigint>")
    )
    facts = [F.first(c).alias(c) for c in ("size", "fp", "sketch")]
    one_each = described.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"), *facts)
    classes = cut(one_each.withColumn("node", F.monotonically_increasing_id()))
    keys = drawn_keys(PARTS, share, recall, classes.count())

    tried = _linked(classes, keys, radius, chunk)
    near = connected_components(tried, "u", "v")
    texts = _texts_of(near, classes, texts)
    decided = cut(verified(tried, texts, width, at_least))
    joined = connected_components(decided.where("alike"), "u", "v")
    for turn in range(NEAREST_ROUNDS + 1):
        open_rows = _open_members(near, joined)
        if open_rows.isEmpty():
            break
        tried = decided.where("not alike")
        pairs = cut(_partners(open_rows, classes, tried, keys, at_least, turn < NEAREST_ROUNDS, chunk))
        if pairs.isEmpty():
            break
        decided = cut(decided.unionByName(verified(pairs, texts, width, at_least)))
        joined = connected_components(decided.where("alike"), "u", "v")

    members = classes.select("node", "digest", "row", "copies").join(joined, "node", "left")
    members = cut(members.select("digest", "row", "copies", "component"))
    least_rows = members.where("component is not null").groupBy("component")
    least_rows = cut(least_rows.agg(F.min("row").alias("least_row"), F.count("*").alias("n")))
    placed = attached(members, least_rows, "component", "n")
    placed = cut(placed.select("digest", F.coalesce("least_row", "row").alias("component"), "copies"))
    rows = attached(described.select("row", "digest"), placed, "digest", "copies")
    return rows.select(F.col("row").alias(row_col), "component")
