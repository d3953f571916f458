"""Corpus pipeline: language ID, near-dedup, substring dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the
last one returns the columns of ``documents``. Stages are written as tables and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import langid, mixing, packing, simhash, substring_dedup
from ledgerlake.llm.common import discard, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Predictions less sure than this (one-versus-rest output below -0.6) are no known language.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; ``lang`` becomes the prediction. Texts without a letter go."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, docs.where("doc_id is not null and lang is not null"))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8), the one with the smallest id."""
    return simhash.keep_first(docs.select(*COLUMNS))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 45 words or more that another document has first; documents that are nothing else go."""
    return substring_dedup.remove_repeats(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once at least, those of small sources again."""
    docs = docs.select(*COLUMNS)
    return mixing.realise(docs, mixing.mix(docs)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document drawn."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
