"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. Partition counts are left to
# adaptive execution, which sizes them from the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows of an index compress more than a hundredfold, so that a partition
    # of the usual 64 MB does not fit a task. Small ones, and enough of them
    # to be joined up to that size, keep a task's memory the same as data grow.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    # The tasks that read texts make rows of words of them, many times as large.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above 8,000 bytes of code. A longer
    # generated stage runs faster as separate, smaller functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that must outlive a lost executor.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without it gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="filingmill-")
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store Spark can reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of a stored table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable on this session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def stored(rows: DataFrame) -> DataFrame:
    """Compute rows once for several uses, in the shared folder."""
    use_checkpoints(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """Rows as a table of known size in the shared folder.

    The planner sees the size, so it broadcasts a small table by itself.
    """
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "'" + text + "'"


def fixed_table(
    spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]
) -> DataFrame:
    """A constant table as inline VALUES.

    The optimiser knows its exact size, so it broadcasts it by itself.
    """
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})"
    )
