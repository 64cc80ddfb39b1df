"""From documents to token ids: filter, dedup, decontaminate, encode.

Each stage takes all that the stage before kept, from a written table, so a
lost executor costs at most tasks of one stage. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.llm import bpe, decontam, exact, neardup, quality
from filingmill.llm.common import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_scores(docs, labels)
    return rows.where(F.col("_score") >= quality.CUT).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.first_copies(docs, exact.dedup(docs, exact.new_index(spark)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 80 % similarity of five-word shingles."""
    return neardup.first_of_components(docs, neardup.near_duplicates(docs, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaky = decontam.leaks(docs, items).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(leaky, docs["doc_id"].eqNullSafe(F.col("_leaky")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and decoded text."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("exact", drop_copies),
    ("neardup", drop_near_copies),
    ("decontam", drop_leaks),
    ("bpe", encode),
]

#: SQL cannot run the classifier's network; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
