"""Groups of near copies, and the pipeline's near-duplicate stage, against brute force."""

import numpy as np
import pytest

import corpus_pipeline as P
from jobloom.llm import near_copies, storage

DOCS = "doc_id bigint, text string, source string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """The row numbers' groups of all pairs with a similarity of 0.8 or more."""
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def near_texts():
    """Copies on both sides of 0.8, of long and short texts, and a line that all of one kind share."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary, 14))
    out = [None, "", " \t", "one", "ONE", "one two three"]
    for length in (6, 9, 14, 40, 120, 300, 1030, 2600):
        for _ in range(3 if length < 1000 else 1):
            words = rng.choice(vocabulary, length).tolist()
            out += [" ".join(words), " ".join(words).upper(), " ".join(words) + " " + line]
            for changes in (1, 2, length // 60, length // 45, length // 40, length // 35, length // 25):
                other = list(words)
                for at in rng.choice(length, changes, replace=False):
                    other[at] = "changed"
                out.append(" ".join(other))
                out.append(" ".join([*words[: length - changes], *["more"] * changes]))
                out.append(" ".join([*words, *[f"end{changes}"] * (changes + length // 6)]))
    return out


def parts(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    return sorted(groups.values())


@pytest.mark.parametrize(("chunk", "rounds"), [(1024, 2), (4, 1), (64, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, chunk, rounds):
    monkeypatch.setattr(near_copies, "NEAREST_ROUNDS", rounds)
    texts = near_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    got = {r.row: r.component for r in near_copies.similar_groups(rows, "row", recall=0.9999, chunk=chunk).collect()}
    assert parts([got[i] for i in range(len(texts))]) == parts(plain_groups(texts))


def test_empty_table(spark):
    assert near_copies.similar_groups(spark.createDataFrame([], "row bigint, text string"), "row").count() == 0


def test_stage_drops_near_copies_only(spark):
    texts = near_texts()
    got = P.one_of_each_group(spark, spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [min(g) for g in parts(plain_groups(texts))]


def test_stage_keeps_one_row_of_each_group_whatever_its_id(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcdef")
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, d), (None, d), (7, e), (7, e), (7, f), (None, None)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], DOCS)
    got = P.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    want = [(3, a), (5, b), (None, c), (None, d), (7, e), (7, f), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_stage_writes_texts_of_candidates_only(spark, monkeypatch):
    written = []

    def watched(df, **how):
        table = storage.cut(df, **how)
        if "text" in table.columns:
            written.extend(r.text for r in table.select("text").collect())
        return table

    monkeypatch.setattr(P, "cut", watched)
    monkeypatch.setattr(near_copies, "cut", watched)
    alone = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdefgh"]
    one = " ".join(f"w{i}" for i in range(60))
    other = one + " more"
    rows = [*enumerate(alone), (3, alone[3]), (20, alone[4]), (30, other), (31, one), (31, one), (32, other)]
    got = P.one_of_each_group(spark, spark.createDataFrame([(i, t, "a") for i, t in rows], DOCS), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [*enumerate(alone), (30, other)]
    assert sorted(written) == [one, other]


def test_tables_of_keys_in_turns(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TABLES", 9)
    texts = [t for t in near_texts() if len((t or "").split()) < 50]
    rows = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "row string, text string")
    got = {int(r.row): int(r.component) for r in near_copies.similar_groups(rows, "row", recall=0.9999).collect()}
    groups = parts(plain_groups(texts))
    assert parts([got[i] for i in range(len(texts))]) == groups
    assert all(got[i] == min(g) for g in groups for i in g)
