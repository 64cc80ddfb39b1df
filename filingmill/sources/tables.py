"""Stored tables: scans, appends, replacements, upserts and patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filingmill.rules import metrics as M
from filingmill.session import (
    fixed_table, path_exists, remove_path, use_checkpoints,
)


def scan(
    table: DataFrame,
    columns: Sequence[str] | None = None,
    equals: Mapping[str, object] | None = None,
    order_by: Sequence[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Column list, equality filters, order and limit over a table."""
    out = table
    for name, value in (equals or {}).items():
        out = out.where(F.col(name) == value)
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


# --------------------------------------------------------------------- sinks



def _cut(column: str, limit: int | None) -> Column:
    return F.col(column) if limit is None else F.substring(column, 1, limit)


def stored_documents(
    documents: DataFrame, content_limit: int | None = None
) -> DataFrame:
    """Rows as the document table keeps them, with a repeatable id.

    Content is whole unless a limit of characters is given.
    """
    key = F.concat_ws(
        "::", "company_id", F.coalesce("document_url", "source_url"), "title"
    )
    return documents.withColumn(
        "content", _cut("content", content_limit)
    ).withColumn("document_id", F.substring(F.sha2(key, 256), 1, 32))


def stored_statements(
    statements: DataFrame, statement_limit: int | None = None
) -> DataFrame:
    return statements.withColumn(
        "statement", _cut("statement", statement_limit)
    ).withColumn("is_processed", F.lit(False))


def append(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_scope(
    rows: DataFrame, path: str, scope: Sequence[str],
    scopes: DataFrame | None = None,
) -> None:
    """Replace the partitions the new rows fall in; leave the others.

    Spark stages the files and swaps whole partitions at job commit, so a
    failed run leaves the old rows in place. ``scopes`` lists scopes that are
    replaced even if they have no new rows: those end up empty. Rows are dealt
    by scope first, so a scope has few files; a large one is split again by
    adaptive execution.
    """
    (
        rows.hint("rebalance", *[F.col(c) for c in scope]).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*scope)
        .parquet(path)
    )
    if scopes is not None:
        spark = rows.sparkSession
        emptied = scopes.select(*scope).distinct().join(
            rows.select(*scope).distinct(), list(scope), "left_anti"
        )
        for row in emptied.toLocalIterator():
            folders = "/".join(f"{c}={_folder(row[c])}" for c in scope)
            remove_path(spark, f"{path}/{folders}")


def _folder(value: object) -> str:
    """A partition value as Spark names its folder."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    special = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in str(value))


def replace_scope_checked(
    spark: SparkSession, rows: DataFrame, path: str, scope: Sequence[str],
    staging: str, scopes: DataFrame | None = None,
) -> int:
    """Stage the rows once, check their count, then replace the scope."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    found, expected = staged.count(), seen.get["n"]
    if found != expected:
        raise ValueError(f"staged {found} of {expected} rows")
    replace_scope(staged, path, scope, scopes)
    return found


def write_chunks(
    chunks: DataFrame, path: str, buckets: int = 256,
    documents: DataFrame | None = None,
) -> None:
    """Replace all chunks of the documents at hand.

    Documents are dealt to ``buckets`` folders by a hash, so the folder count
    does not grow with the documents; give a table the same count each time,
    and one that keeps a bucket near a few hundred MB. Buckets touched by the
    new documents are rewritten whole: rows of other documents are kept.
    ``documents`` lists documents that are replaced even if they have no chunks
    now.
    """
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    fresh = chunks.withColumn("bucket", bucket)
    if not path_exists(spark, path):
        replace_scope(fresh, path, ["bucket"])
        return
    old = spark.read.parquet(path)
    named = fresh.select("document_id", "bucket")
    if documents is not None:
        named = named.unionByName(
            documents.select("document_id").withColumn("bucket", bucket)
        )
    touched = named.select("bucket").distinct()
    kept = old.join(touched, "bucket", "left_semi").join(
        named.select("document_id").distinct(), "document_id", "left_anti"
    )
    use_checkpoints(spark)
    merged = kept.unionByName(fresh.select(*kept.columns)).checkpoint()
    replace_scope(merged, path, ["bucket"], touched)


# ----------------------------------------------------------- upserts, patches


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    keep_old_when_null: Sequence[str] = (),
) -> DataFrame:
    """Insert new keys, update known ones.

    Columns in ``keep_old_when_null`` keep the stored value when the incoming
    one is NULL; every other column takes the incoming value as it is.
    """
    s = source.select(
        *keys,
        *[F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys],
        F.lit(True).alias("_incoming"),
    )
    joined = target.join(s, list(keys), "full_outer")
    out = []
    for c in target.columns:
        new = f"_new_{c}"
        if c in keys or new not in joined.columns:
            out.append(F.col(c))
        elif c in keep_old_when_null:
            out.append(F.coalesce(F.col(new), F.col(c)).alias(c))
        else:
            out.append(
                F.when(F.col("_incoming"), F.col(new))
                .otherwise(F.col(c)).alias(c)
            )
    return joined.select(*out)


def sparse_patch(
    target: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Patch rows by key: a field absent from the map keeps its old value.

    ``patches`` holds ``key`` and ``patch`` (map of column to text). An
    explicit NULL in the map overwrites.
    """
    types = dict(target.dtypes)
    joined = target.join(patches.select(key, "patch"), key, "left")
    patch = F.coalesce("patch", F.expr("map()").cast("map<string,string>"))

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        new = F.try_element_at(patch, F.lit(c)).cast(types[c])
        return (
            F.when(F.map_contains_key(patch, F.lit(c)), new)
            .otherwise(F.col(c)).alias(c)
        )

    return joined.select(*[value(c) for c in target.columns])


def add_missing_companies(companies: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to insert: tickers not stored yet, with the default fields."""
    rows = new.withColumn("ticker", F.upper(F.trim("ticker")))
    defaults = {
        "exchange": F.lit("BSE"),
        "sector": F.lit("Unclassified"),
        "industry": F.lit("Unclassified"),
        "short_description": F.concat(
            F.col("name"), F.lit(" — added automatically.")
        ),
        "is_active": F.lit(True),
    }
    known = companies.select(F.upper("ticker").alias("ticker"))
    return rows.withColumns(defaults).join(known, "ticker", "left_anti")


def append_to_array(table: DataFrame, column: str, extra: Column) -> DataFrame:
    return table.withColumn(column, F.concat(F.col(column), extra))


def copy_array_from(
    table: DataFrame, key: str, source_key: str, target_keys: Sequence[str],
    column: str,
) -> DataFrame:
    """Copy one row's array to other rows; ``key`` is unique in the table."""
    donor = table.where(F.col(key) == source_key).select(
        F.col(column).alias("_copied"),
        F.explode(F.array(*[F.lit(k) for k in target_keys])).alias(key),
    )
    return (
        table.join(donor, key, "left")
        .withColumn(column, F.coalesce("_copied", column))
        .select(*table.columns)
    )


def source_registry(spark: SparkSession) -> DataFrame:
    """The seed of known sources with their trust tiers."""
    rows = [
        (name, kind, tier, M.TIER_LABELS[tier], M.SOURCE_URLS.get(name), True)
        for name, kind, tier in M.SOURCE_REGISTRY
    ]
    columns = [
        "source_name", "source_type", "tier", "tier_label", "base_url",
        "is_active",
    ]
    return fixed_table(spark, columns, rows)
