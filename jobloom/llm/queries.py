"""The numbered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import audio, embedding_dedup, html_extract, license_scan, mixing, packing, quality, secret_scan, simhash, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The default place of the public vocabulary files; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), window=2048, end_id=1)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array(F.col("source").cast("string")))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.features(table(spark, sf_dir, "documents"))
    count = F.length("payload")
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start_ms"].cast("string"), x["end_ms"].cast("string")))
    return made.select(
        "doc_id",
        "n_bytes",
        count.cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("frames="), F.col("n_frames").cast("string")),
            F.concat(F.lit("level="), F.format_number("level", 3)),
            F.concat(F.lit("spans="), F.sha2(F.array_join(spans, ","), 256)),
            F.concat(F.lit("tensors="), F.sha2("tensors", 256)),
        ).alias("feature"),
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, x = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(x, model)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_license_scan": op3_license_scan,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_mixing": op5_mixing,
        "op6_audio": op6_audio,
        "op7_html_extract": op7_html_extract,
        "op8_secret_scan": op8_secret_scan,
        "op9_token_counts": op9_token_counts,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.scan_sql(), "op4_embedding_dedup": embedding_dedup.all_pairs_sql()}
