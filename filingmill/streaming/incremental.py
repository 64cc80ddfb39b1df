"""Incremental jobs: new landed files -> stored tables.

Both run as streams over a landing folder with ``availableNow``: a run takes
the files it has not seen and stops. The work per batch is the batch operator
itself, run in ``foreachBatch``, so a re-run after a lost executor or a
delivered-again file gives the same table.

Each batch writes its own folder ``run=<query id>/batch=<id>`` with overwrite.
The query id is kept in the progress folder. If a batch is replayed after a
crash, it reads the folders of the other batches only and replaces its own. A
job that starts with a new progress folder is another run: it reads all that is
stored, and overwrites nothing of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from filingmill import schemas
from filingmill.operators import dedupe, facts
from filingmill.session import path_exists

METRIC_STATE = "metrics"
QUALITY_STATE = "data_quality"
REJECT_STATE = "rejected"


def _read_before(
    spark: SparkSession, path: str, batch_id: int, schema: T.StructType
) -> DataFrame:
    """Rows of other runs, and of earlier batches of this run.

    Run and batch are folders, so a filter on them prunes whole folders.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T.StructType(
        [*schema.fields, T.StructField("run", T.StringType()),
         T.StructField("batch", T.LongType())]
    )
    mine = F.col("run") == _run_id(spark)
    return (
        spark.read.schema(full).parquet(path)
        .where(~mine | (F.col("batch") < F.lit(batch_id))).drop("run", "batch")
    )


def _run_id(spark: SparkSession) -> str:
    """The id of the running stream; it stays the same with its progress folder."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    run = _run_id(rows.sparkSession)
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def _landed(spark: SparkSession, folder: str, schema: str, per_run: int) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", per_run).parquet(folder)
    )


def stream_items(
    spark: SparkSession, landing: str, store: str, checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """New discovered items -> deduplicated item table under ``store``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old = _read_before(session, store, batch_id, batch.schema)
        stored = dedupe.stored_item_keys(old)
        kept = dedupe.two_key_dedupe(batch, stored).where("kept").drop("kept")
        _write_batch(kept, store, batch_id)

    return (
        _landed(spark, landing, schemas.DISCOVERED_ITEMS, files_per_batch)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_metrics(
    spark: SparkSession, landing: str, store: str, checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """New incoming metrics -> first values, conflicts and rejects.

    ``store`` gets three tables: every batch appends the data points it saw
    first, the conflicts it found and its rejects. ``current_metrics`` derives
    the flags.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = f"{store}/{METRIC_STATE}"
        old = _read_before(session, path, batch_id, batch.schema)
        accepted, rejected = facts.admit(batch)
        kinds = dict(batch.dtypes)
        fresh = facts.new_data_points(accepted, old)
        _write_batch(
            fresh.select(*[F.col(c).cast(kinds[c]) for c in batch.columns]),
            path, batch_id,
        )
        _write_batch(
            facts.metric_conflicts(accepted, old),
            f"{store}/{QUALITY_STATE}", batch_id,
        )
        _write_batch(rejected, f"{store}/{REJECT_STATE}", batch_id)

    return (
        _landed(spark, landing, schemas.INCOMING_METRICS, files_per_batch)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_metrics(spark: SparkSession, store: str) -> DataFrame:
    """The metric table with its conflict flags."""
    metrics = spark.read.parquet(f"{store}/{METRIC_STATE}").drop("run", "batch")
    conflicts = spark.read.parquet(f"{store}/{QUALITY_STATE}")
    flagged = conflicts.select(
        "company_id", F.lower(F.trim("entity_name")).alias("entity_key"),
        "metric_name", "reporting_period", "accounting_basis",
    ).distinct().withColumn("_flag", F.lit(True))
    return (
        metrics.withColumn("entity_key", F.lower(F.trim("entity_name")))
        .join(flagged, facts.CANONICAL_KEY, "left")
        .withColumn(
            "data_quality_status",
            F.when(F.col("_flag"), "CONFLICTING").otherwise("UNVERIFIED"),
        )
        .drop("_flag", "entity_key")
    )
