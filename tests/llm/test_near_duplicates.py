"""SimHash groups and embedding links against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobloom.llm import bitslice, embedding_dedup, hot_keys, queries, simhash
from jobloom.llm.components import connected_components
from tests.same_rows import compare, connect

DOCS = "doc_id bigint, text string, fp string, component_id int, lang string"


def plain_fingerprint(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(8)]
    out = [None, "", "  \t ", "one", "ONE", "one two three", "x " * 30_000]
    for b in base:
        out += [b, b, b.upper()]
        words = b.split(" ")
        for k in range(4):
            words[7 * k] = "changed"
            out.append(" ".join(words))
    return out


def test_fingerprints_are_exact():
    for t in texts():
        assert simhash.signs(simhash.shingle_hashes(t, 4)).tolist() == [plain_fingerprint(t, 4)]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_groups_equal_brute_force(spark, chunk):
    rows = [(i, t, "x", 1, "en") for i, t in enumerate(texts())] + [(0, None, "x", 1, "en"), (None, "one", "x", 1, None)]
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS), radius=4, chunk=chunk).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(r[1], 4) for r in rows]
    pairs = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4]
    label = plain_components(set(prints), pairs)
    least = {}
    for r, f in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[label[f]] = min(least.get(label[f], r[0]), r[0])
    want = sorted((r[0] is None, r[0] or 0, least[label[f]]) for r, f in zip(rows, prints, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == want


@pytest.mark.parametrize("classes", [1, 10**6, 10**9, 10**12])
def test_masked_keys_miss_no_pair(classes):
    rng = np.random.default_rng(8)
    keys = simhash.masked_keys(4, classes)
    one = rng.integers(0, 1 << 63, (500, 1)).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(500)], np.uint64)
    assert (keys(one) == keys(one ^ flips[:, None])).any(axis=1).all()


def test_drawn_keys_grow_and_keep_recall():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    flips = np.packbits(rng.random((3000, 256)) < 0.15, axis=1).view(np.uint64)
    for classes in (10**4, 10**6, 10**8):
        keys = simhash.drawn_keys(4, 0.15, 0.98, classes)
        assert abs((keys(one) == keys(one ^ flips)).any(axis=1).mean() - 0.98) < 0.015
        assert np.bincount(np.unique(keys(one)[:, 0], return_inverse=True)[1]).max() < 60


def test_hot_keys_are_sent_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "HOT_ROWS", 3)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 30), (3, 2), (4, 1)) for i in range(n)], "k bigint, i int")
    facts = spark.createDataFrame([(1, "a", 50), (2, "b", 30), (3, "c", 2)], "k bigint, fact string, n bigint")
    got = hot_keys.attached(rows, facts, "k", "n").groupBy("k", "fact").count().collect()
    assert {tuple(r) for r in got} == {(1, "a", 50), (2, "b", 30), (3, "c", 2), (4, None, 1)}


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("parts", "radius"), [(1, 4), (4, 48)])
def test_bit_slices_equal_popcounts(parts, radius):
    rng = np.random.default_rng(1)
    groups = []
    for n in (2, 3, 65, 130):
        g = rng.integers(0, 1 << 63, (n, parts)).astype(np.uint64)
        g[n // 2] = g[0] ^ np.uint64(0b1011)
        groups.append(g)
    found = {(g, r): set(bitslice.members(m)) for g, r, m in bitslice.near_rows(groups, radius)}
    for k, g in enumerate(groups):
        for i in range(len(g)):
            near = {j for j in range(len(g)) if j != i and sum(int(x).bit_count() for x in g[i] ^ g[j]) <= radius}
            assert found.get((k, i), set()) == near


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 1), (3, 1)]
    got = connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, node string"


@pytest.mark.parametrize("chunk", [16, 1024])
def test_vectors_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 24))
    x = np.repeat(centres, 6, axis=0) + 0.12 * rng.standard_normal((72, 24))
    x = np.vstack([x, x[:3], x[:1] * 5]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3, "n") for i, v in enumerate(x)]
    odd = [(900, None, 0, ""), (901, [0.0] * 24, 0, ""), (902, [float("nan")] * 24, 0, ""), (903, [None] * 24, 0, ""), (904, [], 0, "")]
    odd.append((905, x[0][:12].tolist(), 0, ""))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, VECTORS), chunk=chunk).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near[i, j]]
    label = plain_components(range(len(x)), pairs)
    recall = sum(got[i].n_links for i in range(len(x))) / (near.sum() - len(x))
    assert 0.9 <= recall <= 1.0
    assert sum(got[i].component_id == label[i] for i in range(len(x))) >= 0.95 * len(x)
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    nulls = spark.createDataFrame([(1, None, 0, ""), (None, None, 0, "")], VECTORS)
    assert embedding_dedup.near_vectors(nulls).where(F.col("kept")).count() == 2


def test_repeated_ids_of_unlike_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 0, ""), (5, b, 0, ""), (7, [1.0, 0.1, 0.0], 0, ""), (8, [0.1, 1.0, 0.0], 0, ""), (9, [0.0, 1.0, 0.1], 0, "")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (5, 1, 5, True), (5, 2, 5, True), (7, 1, 5, False), (8, 2, 5, False), (9, 2, 5, False),
    ]


def test_string_ids(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows).collect()}
    assert got == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}


def test_vectors_equal_all_pairs_in_sql(spark):
    found = "/root/testdata/sf0.01"
    compare(queries.op4_embedding_dedup(spark, found), connect(found), embedding_dedup.all_pairs_sql())
