"""The corpus pipeline: low quality out, near-duplicates out, secrets masked, sources mixed, documents packed.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and further
columns, as the operator that it calls defines it: a null or empty text is scored like any other, is one class of
near-duplicates, holds no secret, is never taken by the mix, and packs as one token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import mixing, near_copies, packing, quality, secret_scan
from jobloom.llm.queries import tokenizer_path
from jobloom.llm.storage import cut, discard, scratch, shared_folder
from jobloom.session import prepare

#: So many rows' identities are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: The identity of a row within the near-duplicate stage: its id and two hashes of its text, in the order of choice.
ROW = "near_dedup_row"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on 100,000 of these documents' labels at most, scores 0.5 or more."""
    prepare(spark)
    return quality.keep_good(docs, quality.train_on_some(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, null ids last; of equal ids, by the text's hash.

    Documents are linked whose sets of five-word shingles have a similarity of 0.8 or more; what links reach is a group.
    Rows are chosen, not ids: other rows of a chosen or dropped id stand in their own groups. Of rows alike in id and
    text any one is kept. Documents are not copied: they are read again, and known by id and text.
    """
    prepare(spark)
    identity = F.struct(
        F.col("doc_id").isNull().alias("without_id"),
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.lit(1), "text").alias("second_hash"),
    )
    known = docs.withColumn(ROW, identity)
    with scratch(spark):
        placed = cut(near_copies.similar_groups(known, ROW, width=5, least="0.8"))
        chosen = F.col(ROW) == F.col("component")
        again = placed.where(chosen).groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW)
        again = cut(again, outlast=True)
        dropped = cut(placed.where(~chosen).select(ROW).distinct(), outlast=True)
    unlike = known.join(_sent(dropped.unionByName(again)), ROW, "left_anti")
    if not again.isEmpty():
        unlike = unlike.unionByName(known.join(_sent(again), ROW).dropDuplicates([ROW]))
    return unlike.select(docs.columns)


def _sent(rows: DataFrame) -> DataFrame:
    """rows, sent to every task where there are BROADCAST_ROWS at most."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark; n_chars follows the text."""
    prepare(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    prepare(spark)
    taken = mixing.mix(docs, F.array(F.col("source").cast("string")), whole_documents=True)
    times = F.when(F.col("mix_size") > 0, F.col("mix_taken") / F.col("mix_size")).otherwise(0).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))
    return taken.withColumn("mix_copy", copies).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("secrets", secrets_masked),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm compares the pipeline with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and reread, and removed after the next."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return docs
