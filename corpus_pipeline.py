"""Corpus pipeline: from raw documents to packed training windows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.llm import byte_tokens, minhash, packing, quality, stages, substring_dedup, toxicity
from wavequery.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# A classifier is trained on the way, which SQL cannot express.
ORACLE_SQL = None


# Links of the near-duplicate stage: shared shingles of all, in percent.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts have a score too, and go or stay by it; repeated rows go or stay together, and a score at the limit goes. Without
    labels nothing is rejected. Other columns are left out; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD).drop("score")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules.

    Null and empty texts have no words and are rejected as too short; repeated rows are judged each, alike; a text exactly at a limit
    passes. Other columns are left out; an empty table stays empty.
    """
    return quality.judged(quality.measure(docs, keep=COLUMNS[1:])).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest ``doc_id``, and one row of each ``doc_id``.

    Of several rows of one ``doc_id`` the one that is first by text (null before all) and then by the other columns
    stays. Rows without a ``doc_id`` cannot be named and all stay; null and empty texts are like no other. Other
    columns are left out; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id")
    again = named.agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row"))
    once = docs.join(again, "doc_id", "left_anti").unionByName(one.select("doc_id", "_row.*"))
    once = stages.written(once, "pipeline-once")
    copies = minhash.linked(once, NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return once.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has.

    A text that loses nothing stays as it is, null too; one that loses words has a new ``n_chars``, and may be left empty. A row
    without a ``doc_id`` stays whole and takes nothing from others; rows of one ``doc_id`` share a place in the order, so neither
    is the earlier one. Other columns are left out; an empty table stays empty.
    """
    left = substring_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids.

    Null and empty texts are their end id alone; repeated rows are packed each; a null ``doc_id`` stays null on its pieces. Other
    columns are left out; an empty table has no pieces.
    """
    return packing.packed(docs, public_tokenizers.path(byte_tokens.VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
