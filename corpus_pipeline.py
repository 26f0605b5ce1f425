"""A corpus pipeline of five stages, each one operator of waymill.llm: quality, near copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame; run() writes each stage's result as
Parquet into the shared folder and hands the next one what it reads back. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import best_fit_pack, quality_mil, simhash_near, source_mix, suffix_dedup
from waymill.llm.common import id_crc, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more; learned from the rows of labels whose id's checksum mod 4 is not 2. Each
    row, with a single id, a repeated one or none, is judged by its own text; a null text is judged as an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_crc() % 4 != 2)
    scored = quality_mil.scores(docs.select(*COLUMNS), quality_mil.learn(docs, labels), COLUMNS)
    return scored.where("score >= 0.7").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: linked by a Jaccard similarity of 0.8 or more over five-word
    shingles, among texts that SimHash over distinct words (7 differing bits at most, by either of two hashes) puts together. Each row counts by
    itself: of rows that repeat an id and text one stays, of an id with several texts each is judged alone, and rows without an id stay."""
    own = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("rid"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        own = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("rid")), "near-numbered")
    found = materialize(simhash_near.verified_duplicates(own).where("doc_id is not null"), "near-found")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).getField("rid").alias("stays"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select("component", "stays"), "near-stays")
    gone = found.join(first, "component").where("rid <> stays").select("rid")
    return own.join(gone, "rid", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier too, or of characters that the cut went through; n_chars counts anew.
    No row goes: rows that repeat an id, or have none, are documents of their own (suffix_dedup tells their order); a text that stood before
    in whole is left empty, a null text stays null."""
    kept = suffix_dedup.without_repeats(docs.select(*COLUMNS), size=100, keep=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    n_chars = F.when(cut, F.char_length("cut_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.when(cut, F.col("cut_text")).otherwise(F.col("text")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that languages' token totals come to shares of the present ones to the power 0.7. Each row is repeated by
    itself, with or without an id of its own; none is left out. A null text counts as empty and stays once."""
    labelled = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct(), "doc_id", "left_semi")
    model = source_mix.learn(labelled.select("doc_id", "text", F.col("lang").alias("domain")))
    own = source_mix.rates(docs, model, source_mix.flattened_targets, least=1.0, keep=COLUMNS)
    return own.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).select("kept.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, of every row: repeated ones, rows without an id and null texts (as empty)
    too."""
    return best_fit_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
