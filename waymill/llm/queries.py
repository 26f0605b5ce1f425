"""The registered query of each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_pack, media_columns, multiset_hash, ppm_score, quality_mil, ring_shard, simhash_near, source_mix, suffix_dedup, token_count
from .common import id_crc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), id_crc() % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    scored = quality_mil.scores(docs.withColumn("doc_id", F.col("doc_id").cast("long")), quality_mil.learn(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.scores(documents(spark, sf_dir), id_crc() % 10 != 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(documents(spark, sf_dir), size=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_table(documents(spark, sf_dir))


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.next_edits(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near.near_duplicates(documents(spark, sf_dir), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct(), "doc_id", "left_semi")
    model = source_mix.learn(labelled.select("doc_id", "text", F.col("lang").alias("domain")))
    return source_mix.rates(docs, model, source_mix.equal_targets)


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring_shard.assign(documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
