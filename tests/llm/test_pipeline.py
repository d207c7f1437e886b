"""The pipeline stage by stage against plain code, and the registry."""

from jobloom.llm import quality, queries, secret_scan

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    model, _ = quality.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    import numpy as np

    good = {i for i, r in source.items() if model.score(np.array([quality.statistics(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in kept["quality"].collect()} == good
    unique = [r.doc_id for r in kept["near_dedup"].collect()]
    assert len(unique) == len(set(unique)) and set(unique) <= good
    texts = {source[i].text for i in unique}
    assert len(texts) == len(unique)
    clean = {r.doc_id: r for r in kept["secrets"].collect()}
    assert clean.keys() == set(unique)
    spans = {r.doc_id: r.spans for r in secret_scan.scan(kept["near_dedup"]).collect()}
    assert all((clean[i].text == source[i].text) == (spans[i] == "") for i in clean)
    assert all(r.n_chars == len(r.text) for r in clean.values())
    mixed = [r.doc_id for r in kept["mixing"].collect()]
    assert set(mixed) <= clean.keys() and max(map(mixed.count, set(mixed))) <= 2
    pieces = kept["packing"].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] & (r[1] - 1) == 0 for r in pieces)


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    real = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()]
    odd = [(None, None, None, None, None), (7, None, "en", "s", 0), (7, "", "en", "s", 0), (None, "a b c", None, None, 5), real[0], real[0]]
    odd.append((9, "secret: abcdefghijklmnop " + "word " * 60_000, "en", "s", 300_025))
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    more = ", row int, node int, digest string, mix_size int, fp int, x int, y int, secret_count int"
    rows = [(*r, 1, 2, "d", 3, 4, 5, 6, 7) for r in [*real, *odd]]
    for name, frame in (("some", spark.createDataFrame(rows, kinds + more)), ("none", spark.createDataFrame([], kinds + more))):
        docs = frame
        for stage_name, stage in P.STAGES:
            out = str(tmp_path / f"{name}-{stage_name}")
            stage(spark, docs, DIR).write.parquet(out)
            after = spark.read.parquet(out)
            assert stage_name == "packing" or after.columns == frame.columns
            assert name == "some" or after.count() == 0
            docs = after
    kept = spark.read.parquet(str(tmp_path / "some-near_dedup")).collect()
    assert len({r.text or "" for r in kept}) == len(kept)
    masked = [r.text for r in spark.read.parquet(str(tmp_path / "some-secrets")).collect()]
    assert not any("abcdefghijklmnop" in (t or "") for t in masked)


def test_registry():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert queries.oracle_sql().keys() < names.keys()
