"""Exact dedup against a persistent digest index.

The index is a Parquet table of (digest, keep_id), bucketed and sorted by the
digest. New rows are reduced to one row per digest, a sort-merge anti-join
leaves the digests that the index lacks, and these are appended. Only digests
are shuffled, never texts. Everything runs as DataFrame operations.

Defined results: a null text counts as the empty text, and all empty texts are
equal. Of equal texts the row with the smallest key stays; null keys come last,
and if a group has null keys alone, ``keep_id`` is null and all its rows are
reported as kept. Rows repeated with the same key and text are each reported,
``kept`` alike; ``first_copies`` leaves one of them. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingmill.llm.common import stored, text_of, work_folder

#: Parts that a group of equal texts is cut into before it is gathered, so
#: that no task gets a whole hot group.
PARTS = 64


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digest_of(column: str) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text_of(column)), 256))


def open_index(
    spark: SparkSession, path: str, buckets: int | None = None
) -> str:
    """Create the index at ``path``, or attach the one that is there.

    The bucket count is a property of the stored files: give the same one each
    time. Without one, a new index takes ``spark.sql.shuffle.partitions``.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    return name


def dedup(
    docs: DataFrame, index: str, buckets: int | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Decide each row of ``docs`` and append new digests to the index.

    Returns one row per input row: the key, ``keep_id`` (the row that stays,
    from the index if it knows the text), ``group_size`` (rows of ``docs`` with
    that text), ``kept`` and ``digest``.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(PARTS))
    # Digest and part are one key of 33 bytes, so that no exchange falls back
    # to the digest alone, which a hot group shares.
    narrow = stored(
        docs.select(F.col(key).alias("key"), digest_of(text).alias("digest")).select(
            "key", F.concat("digest", F.unhex(F.lpad(F.hex(part), 2, "0"))).alias("spot")
        ),
        "digests",
    )
    digest = F.substring("spot", 1, 32)
    parts = narrow.groupBy("spot").agg(
        F.min("key").alias("low"), F.count(F.lit(1)).alias("n")
    ).withColumn("digest", digest)
    groups = parts.groupBy("digest").agg(
        F.min("low").alias("low"), F.sum("n").alias("group_size")
    )
    known = spark.table(index).select("digest", "keep_id")
    fresh = groups.join(known.hint("merge"), "digest", "left_anti")
    (
        fresh.select("digest", F.col("low").alias("keep_id"))
        .repartition(buckets, "digest")
        .write.insertInto(index)
    )
    spark.catalog.refreshTable(index)
    known = spark.table(index).select("digest", "keep_id")
    decided = groups.join(known.hint("merge"), "digest").select(
        "digest", "keep_id", "group_size"
    )
    spots = parts.select("spot", "digest").join(decided, "digest")
    return narrow.join(spots, "spot").select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def first_copies(
    docs: DataFrame, decisions: DataFrame,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    Rows are matched by key and digest, so a key used for two texts is safe.
    Texts stay where they are unless a key repeats with the same text.
    """
    mine = docs.withColumn("_exact_digest", digest_of(text))
    marks = decisions.groupBy(
        F.col(key).alias("_exact_key"), F.col("digest").alias("_exact_mark")
    ).agg(F.bool_and("kept").alias("_exact_stays"), F.count(F.lit(1)).alias("_exact_rows"))
    names = ["_exact_key", "_exact_mark"]
    same = [
        mine[key].eqNullSafe(F.col("_exact_key")),
        mine["_exact_digest"] == F.col("_exact_mark"),
    ]
    several = F.col("_exact_rows") > 1
    special = marks.where(~F.col("_exact_stays") | several).select(*names)
    repeated = marks.where(F.col("_exact_stays") & several).select(*names)
    single = mine.join(special, same, "left_anti").select(*docs.columns)
    copy = Window.partitionBy(key, "_exact_digest").orderBy(key)
    once = (
        mine.join(repeated, same, "left_semi")
        .withColumn("_exact_copy", F.row_number().over(copy))
        .where(F.col("_exact_copy") == 1)
        .select(*docs.columns)
    )
    return single.unionByName(once)


def new_index(spark: SparkSession) -> str:
    """An empty index in a new shared folder."""
    return open_index(spark, work_folder(spark, "digest-index"))
