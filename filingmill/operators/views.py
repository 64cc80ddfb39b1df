"""Read views: search, directory, feed, queue, metric list and row checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.rules import metrics as M

NAME_LIMIT = 10
DIRECTORY_LIMIT = 200
QUEUE_LIMIT = 50
METRIC_LIMIT = 200
FILINGS_PER_RUN = 10

EPOCH = "1970-01-01 00:00:00"


# ------------------------------------------------------------------- companies


def search_companies(companies: DataFrame, term: str, limit: int = NAME_LIMIT) -> DataFrame:
    """Case-insensitive substring search on names, then on tickers.

    Each side is cut to its limit in a fixed order (name, id); the union keeps
    the first occurrence of a company. An empty term finds nothing.
    """
    needle = F.lower(T.clean_search_term(F.lit(term)))
    columns = ["company_id", "name", "ticker", "exchange", "short_description"]

    def side(column: str, n: int) -> DataFrame:
        return (
            companies.where(
                (needle != "") & F.contains(F.lower(column), needle)
            )
            .select(*columns, F.lit(n).alias("side"))
            .orderBy("name", "company_id").limit(limit)
        )

    both = side("name", 0).unionByName(side("ticker", 1))
    first = Window.partitionBy("company_id").orderBy("side")
    return (
        both.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1").drop("_rn").orderBy("side", "name", "company_id")
    )


def directory(companies: DataFrame, limit: int = DIRECTORY_LIMIT) -> DataFrame:
    """Active companies by name."""
    return (
        companies.where("is_active")
        .select("company_id", "name", "ticker", "exchange", "short_description")
        .orderBy("name", "company_id").limit(limit)
    )


def clean_ticker(c: Column) -> Column:
    return F.regexp_replace(F.upper(T.trim_space(c)), "[^A-Z0-9.-]", "")


def company_research(
    companies: DataFrame, research: DataFrame, ticker: Column | str
) -> DataFrame:
    """A company by ticker with its report rows, oldest first."""
    wanted = clean_ticker(F.lit(ticker) if isinstance(ticker, str) else ticker)
    return (
        companies.where(F.col("ticker") == wanted)
        .select("company_id", "name", "ticker")
        .join(research, "company_id")
        .orderBy("created_at", "research_id")
    )


def with_parent(companies: DataFrame) -> DataFrame:
    """Each company with the name of its parent."""
    parents = companies.select(
        F.col("company_id").alias("parent_company_id"),
        F.col("name").alias("parent_name"),
    )
    return companies.join(parents, "parent_company_id", "left")


def exchange_codes(companies: DataFrame) -> DataFrame:
    """Exchange code of each ticker, with a note where none is known."""
    code = T.map_value(M.EXCHANGE_CODES, F.upper("ticker"))
    return companies.withColumn("exchange_code", code).withColumn(
        "exchange_error",
        F.when(
            F.col("exchange_code").isNull(),
            F.concat(F.lit("No exchange code for ticker "), F.col("ticker")),
        ),
    )


# ------------------------------------------------------------------------ feed


def _top(rows: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """First n rows per company, or all; the group limit prunes before the shuffle."""
    if n is None:
        return rows
    window = Window.partitionBy("company_id").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= n).drop("_rn")
    )


def latest_news(news: DataFrame, n: int | None = None) -> DataFrame:
    order = [F.desc_nulls_last("published_at"), F.col("news_id")]
    return _top(news, order, n)


def latest_documents(documents: DataFrame, n: int | None = None) -> DataFrame:
    order = [F.desc_nulls_last("publication_date"), F.col("document_id")]
    return _top(documents, order, n)


def feed_items(news: DataFrame, documents: DataFrame) -> DataFrame:
    """News and documents in one item shape; unknown types are filings."""
    kind = F.lower(F.coalesce("document_type", F.lit("")))
    known = [t for t in M.SOURCE_TYPES if t != "news"]
    news_side = news.select(
        "company_id",
        F.col("news_id").alias("item_id"),
        F.lit("news").alias("source_type"),
        F.col("headline").alias("title"),
        F.col("summary").alias("summary"),
        F.col("published_at").alias("published_at"),
        F.col("source_name").alias("publisher"),
        F.col("category").alias("category"),
        F.col("source_url").alias("original_url"),
        F.col("relevance_score").alias("relevance_score"),
    )
    document_side = documents.select(
        "company_id",
        F.col("document_id").alias("item_id"),
        F.when(kind.isin(known), kind).otherwise("filing").alias("source_type"),
        "title",
        F.coalesce(
            F.col("publication_date").cast("timestamp"),
            F.col("document_date").cast("timestamp"),
            F.col("created_at"),
        ).alias("published_at"),
        F.col("source_name").alias("publisher"),
        F.col("document_type").alias("category"),
        F.col("source_url").alias("original_url"),
        "document_url",
        F.col("reporting_period").alias("quarter"),
        F.col("reporting_period").alias("financial_year"),
        F.coalesce("processing_status", "text_extraction_status")
        .alias("status"),
    )
    return news_side.unionByName(document_side, allowMissingColumns=True)


def feed_order() -> list[Column]:
    """Newest first; a missing date counts as the epoch."""
    when = F.coalesce("published_at", F.lit(EPOCH).cast("timestamp"))
    return [F.desc(when), F.col("source_type"), F.col("item_id")]


def company_feed(
    companies: DataFrame, news: DataFrame, documents: DataFrame,
    ticker: str | None = None, source_type: str = "all",
    n_news: int | None = None, n_documents: int | None = None,
) -> DataFrame:
    """All, or the latest, news and documents per company in one ordered feed.

    Each company's place in its feed comes as ``feed_rank``. Items are ranked
    within their day and the days are added up, so no task orders a whole
    company.
    """
    wanted = companies.select("company_id", "ticker")
    if ticker is not None:
        wanted = wanted.where(F.col("ticker") == F.upper(F.trim(F.lit(ticker))))
    items = feed_items(
        latest_news(news, n_news), latest_documents(documents, n_documents)
    )
    items = items.join(wanted, "company_id")
    if source_type != "all":
        items = items.where(F.col("source_type") == source_type)
    items = items.withColumn(
        "_day", F.to_date(F.coalesce("published_at", F.lit(EPOCH).cast("timestamp")))
    )
    later = (
        Window.partitionBy("company_id").orderBy(F.desc("_day"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    days = (
        items.groupBy("company_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .drop("_n")
    )
    window = Window.partitionBy("company_id", "_day").orderBy(*feed_order())
    return (
        items.withColumn("_rank", F.row_number().over(window))
        .join(days, ["company_id", "_day"])
        .withColumn("feed_rank", (F.col("_before") + F.col("_rank")).cast("int"))
        .drop("_day", "_rank", "_before")
    )


def _type_grid(companies: DataFrame) -> DataFrame:
    types = F.array(*[F.lit(t) for t in M.SOURCE_TYPES])
    return companies.select("company_id", F.explode(types).alias("source_type"))


def feed_counts(companies: DataFrame, items: DataFrame) -> DataFrame:
    """Items per company and source type; all six types are present."""
    keys = ["company_id", "source_type"]
    counts = items.groupBy(*keys).agg(F.count("*").alias("n_items"))
    return _type_grid(companies).join(counts, keys, "left").na.fill(
        0, ["n_items"]
    )


def persist_report(companies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fetched, stored, skipped and first error per source type.

    ``outcomes`` has company_id, source_type, arrival, kept and error.
    """
    keys = ["company_id", "source_type"]
    failed = F.col("error").isNotNull()
    counts = outcomes.groupBy(*keys).agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("kept") & ~failed).alias("stored"),
        F.count_if(~F.col("kept") & ~failed).alias("skipped"),
        F.min_by("error", F.when(failed, F.col("arrival")))
        .alias("first_error"),
    )
    return _type_grid(companies).join(counts, keys, "left").na.fill(
        0, ["fetched", "stored", "skipped"]
    )


# ----------------------------------------------------------------------- queue


def queue_counts(queue: DataFrame) -> DataFrame:
    """Queue rows per retrieval status, with the total as its own row."""
    counts = queue.groupBy("retrieval_status").agg(
        F.count("*").alias("n_filings")
    )
    total = counts.select(
        F.lit("total").alias("retrieval_status"), "n_filings"
    ).groupBy("retrieval_status").agg(F.sum("n_filings").alias("n_filings"))
    return counts.unionByName(total)


def queue_latest(queue: DataFrame, n: int = QUEUE_LIMIT) -> DataFrame:
    """Newest queue rows per company."""
    return _top(queue, [F.desc_nulls_last("discovered_at"), F.col("filing_id")], n)


def work_queue(queue: DataFrame) -> DataFrame:
    """Rows that still need retrieval or processing."""
    return queue.where(
        F.col("retrieval_status").isin("pending", "blocked")
        | F.col("processing_status").isin("unprocessed", "queued")
    )


def quality_watch(metrics: DataFrame) -> DataFrame:
    return metrics.where(
        F.col("data_quality_status").isin("CONFLICTING", "MISSING")
    )


def unread_news(news: DataFrame) -> DataFrame:
    return news.where(~F.col("is_processed"))


def open_conflicts(data_quality: DataFrame) -> DataFrame:
    return data_quality.where(F.col("resolution_status") == "pending")


def first_filings(filings: DataFrame, n: int = FILINGS_PER_RUN) -> DataFrame:
    """First filings per company in discovery order."""
    return _top(filings, [F.col("arrival")], n)


def pipeline_report(stages: DataFrame) -> DataFrame:
    """Stage counters and the status ladder per company.

    ``stages`` has one row per stage result: company_id, stage, ok, blocked,
    n_metrics and n_conflicts.
    """

    def count(stage: str, *more: Column) -> Column:
        cond = F.col("stage") == stage
        for m in more:
            cond = cond & m
        return F.count_if(cond)

    ok, blocked = F.col("ok"), F.coalesce("blocked", F.lit(False))
    out = stages.groupBy("company_id").agg(
        count("discovery").alias("sources_attempted"),
        count("discovery", ok).alias("sources_succeeded"),
        count("filing").alias("filings_discovered"),
        count("retrieval", ok).alias("retrieved"),
        count("retrieval", ~ok).alias("retrieval_failed"),
        count("retrieval", ~ok, blocked).alias("retrieval_blocked"),
        count("extraction", ok).alias("extracted"),
        F.coalesce(F.sum("n_metrics"), F.lit(0)).alias("metrics_stored"),
        F.coalesce(F.sum("n_conflicts"), F.lit(0)).alias("conflicts"),
        F.bool_and(F.when(F.col("stage") == "discovery", ~ok))
        .alias("all_sources_failed"),
    )
    return out.withColumn(
        "status",
        F.when(F.col("metrics_stored") > 0, "data_stored")
        .when(F.col("retrieved") > 0, "retrieved_no_metrics")
        .when(F.col("filings_discovered") > 0, "discovered_not_retrieved")
        .otherwise("discovery_failed"),
    )


# --------------------------------------------------------------------- metrics

METRIC_COLUMNS = [
    "metric_name", "metric_value", "metric_unit", "currency",
    "reporting_period", "accounting_basis", "entity_name", "source_name",
    "source_tier", "data_quality_status",
]


def metric_list(
    metrics: DataFrame, company_id: object, basis: str | None = None,
    period: str | None = None, limit: int = METRIC_LIMIT,
) -> DataFrame:
    """A company's metrics: period descending as text, then metric name."""
    rows = metrics.where(F.col("company_id") == company_id)
    if basis is not None:
        rows = rows.where(F.col("accounting_basis") == basis)
    if period is not None:
        rows = rows.where(F.col("reporting_period") == period)
    return (
        rows.orderBy(
            F.desc("reporting_period"), "metric_name", "accounting_basis",
            "entity_name",
        )
        .limit(limit).select(*METRIC_COLUMNS)
    )


# ------------------------------------------------------------------ row checks


def row_checks(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Names of the failed checks of each row.

    As in a table constraint, a check with an unknown outcome passes.
    """
    failed = [
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(name))
        for name, ok in checks.items()
    ]
    return rows.withColumn("violations", F.array_compact(F.array(*failed)))


def between_or_null(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


# Checks of the stored tables, by table.
TABLE_CHECKS = {
    "financial_metrics": {
        "tier": ("source_tier", 1, 4),
        "quarter": ("quarter", 1, 4),
    },
    "shareholding": {
        "promoter_pct": ("promoter_holding_pct", 0, 100),
        "pledged_pct": ("promoter_pledged_pct", 0, 100),
        "fii_pct": ("fii_fpi_holding_pct", 0, 100),
        "dii_pct": ("dii_holding_pct", 0, 100),
        "public_pct": ("public_holding_pct", 0, 100),
    },
    "news": {
        "relevance": ("relevance_score", 0, 1),
        "tier": ("source_tier", 1, 4),
    },
}


def table_checks(table: str) -> dict[str, Column]:
    return {
        name: between_or_null(*rule)
        for name, rule in TABLE_CHECKS[table].items()
    }


def document_preflight(documents: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Identity and status columns that differ from the wanted values."""
    failed = [
        F.when(~F.col(c).eqNullSafe(v), F.lit(c)) for c, v in wanted.items()
    ]
    return documents.withColumn(
        "violations", F.array_compact(F.array(*failed))
    )
