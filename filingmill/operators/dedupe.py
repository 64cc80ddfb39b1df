"""Order-dependent two-key deduplication of discovered items.

An item is kept when neither its URL nor its normalised title belongs to an
item kept (or stored) earlier. A skipped item does not block its keys, so two
plain ``dropDuplicates`` would lose rows. The rounds below are exact: in each
one an item that is the earliest undecided holder of both its keys is kept,
and every undecided item sharing a key with it is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.session import use_checkpoints

SCOPE = ["company_id", "kind"]


def is_news(source_type: Column) -> Column:
    return source_type == "news"


def item_keys(items: DataFrame) -> DataFrame:
    """Scope and the two keys of each item."""
    news = is_news(F.col("source_type"))
    url = F.when(news, F.col("original_url")).otherwise(
        F.coalesce("document_url", "original_url")
    )
    title = F.when(news, F.coalesce("headline", "title")).otherwise(
        F.col("title")
    )
    return items.select(
        "company_id",
        F.when(news, "news").otherwise("document").alias("kind"),
        "arrival",
        F.coalesce(url, F.lit("")).alias("k1"),
        F.coalesce(T.normalise_title(title), F.lit("")).alias("k2"),
    )


def stored_keys(
    news: DataFrame | None = None, documents: DataFrame | None = None
) -> DataFrame | None:
    """Keys of stored rows: news URL and headline; document URLs and title."""
    out = None
    if news is not None:
        out = news.select(
            "company_id", F.lit("news").alias("kind"),
            F.explode(
                F.array("source_url", T.normalise_title(F.col("headline")))
            ).alias("k"),
        )
    if documents is not None:
        rows = documents.select(
            "company_id", F.lit("document").alias("kind"),
            F.explode(
                F.array(
                    "document_url", "source_url",
                    T.normalise_title(F.col("title")),
                )
            ).alias("k"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return None
    return out.where("k IS NOT NULL AND k <> ''").distinct()


def stored_item_keys(items: DataFrame) -> DataFrame:
    """Keys of items kept by an earlier run."""
    rows = item_keys(items)
    return rows.select(
        *SCOPE, F.explode(F.array("k1", "k2")).alias("k")
    ).where("k IS NOT NULL AND k <> ''").distinct()


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows neither of whose keys is in ``keys``."""
    for name in ["k1", "k2"]:
        rows = rows.join(
            keys.withColumnRenamed("k", name), [*SCOPE, name], "left_anti"
        )
    return rows


def _key_rows(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        *SCOPE, *extra, F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k")
    )


def kept_arrivals(items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Scope and arrival of the items to keep.

    Exact copies (same two keys) first shrink to their earliest item with a
    map-side combine: a later copy can never be kept, whatever happens to the
    first. What is left per key is bounded by distinct key pairs.
    """
    undecided = (
        item_keys(items)
        .groupBy(*SCOPE, "k1", "k2")
        .agg(F.min("arrival").alias("arrival"))
    )
    if stored is not None:
        undecided = _without(undecided, stored)
    use_checkpoints(items.sparkSession)
    undecided = undecided.checkpoint()
    kept_rounds: list[DataFrame] = []
    while not undecided.isEmpty():
        earliest = (
            _key_rows(undecided, "arrival")
            .groupBy(*SCOPE, "k").agg(F.min("arrival").alias("first"))
        )
        marked = undecided
        for name in ["k1", "k2"]:
            marked = marked.join(
                earliest.select(
                    *SCOPE, F.col("k").alias(name),
                    F.col("first").alias(f"first_{name}"),
                ),
                [*SCOPE, name],
            )
        kept = F.col("arrival") == F.greatest("first_k1", "first_k2")
        kept = kept & (F.col("first_k1") == F.col("first_k2"))
        marked = marked.withColumn("kept", kept).checkpoint()
        winners = marked.where("kept")
        kept_rounds.append(winners.select(*SCOPE, "arrival"))
        rest = marked.where("NOT kept").select(*undecided.columns)
        undecided = _without(rest, _key_rows(winners)).checkpoint()
    if not kept_rounds:
        return undecided.select(*SCOPE, "arrival")
    out = kept_rounds[0]
    for kept_round in kept_rounds[1:]:
        out = out.unionByName(kept_round)
    return out


def two_key_dedupe(items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Items with a ``kept`` flag; ``arrival`` is unique per company."""
    kept = kept_arrivals(items, stored).withColumn("_kept", F.lit(True))
    kind = F.when(is_news(F.col("source_type")), "news").otherwise("document")
    return (
        items.withColumn("kind", kind)
        .join(kept, [*SCOPE, "arrival"], "left")
        .withColumn("kept", F.coalesce("_kept", F.lit(False)))
        .drop("_kept", "kind")
    )
