"""Training-data pipeline over the documents table: language ID, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, language_id, minhash, packing, substring_dedup
from eventloom.llm.common import discard, materialise, scratch, shared_dir, table
from eventloom.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of many letters and yet unlike every language learned from the table, go.

    A null lang becomes the language found. Where no row has a lang nothing is learned, and all rows stay. Rows are judged one by one
    by their text, so null and repeated doc_ids don't matter.
    """
    prototypes = language_id.train(docs.where("lang is not null"))
    if not prototypes:
        return docs
    kept = language_id.predict(docs, prototypes).where(~language_id.rejected())
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of those at five-word Jaccard 0.8 and more stays: op8's SimHash classes, and MinHash bands beyond their reach, held to exact similarity."""
    return minhash.representatives(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the prototypes, walks and packing; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of earlier stages, and what a stage wrote on the way, go once the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if written:
            discard(docs)
        docs = written = spark.read.parquet(path)
    return docs
