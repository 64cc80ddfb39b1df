"""Shared folders, stored tables and text batches of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy step of a task holds at once, in characters.
BATCH_CHARS = 1 << 20
#: Rows of a batch that Spark hands to Python.
BATCH_ROWS = 500


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share.

    It lies in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="filingmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder once and read them back.

    Later jobs, and tasks repeated after a lost executor, read the files.
    """
    spark = rows.sparkSession
    path = work_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows that Spark hands to Python at once, for tasks planned from now on.

    The default of 10,000 is too much for whole texts and register sets.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[range]:
    """Runs of neighbouring rows of about ``limit`` characters each.

    A text longer than the limit is a run of its own.
    """
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield range(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield range(start, len(texts))
