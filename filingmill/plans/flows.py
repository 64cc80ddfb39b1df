"""The user-level jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.operators import chunks as C
from filingmill.operators import conclusions as K
from filingmill.operators import dedupe, facts, qa, report, retrieve
from filingmill.rules import research as R
from filingmill.rules import words as W
from filingmill.sources import feeds, tables


def discover(
    announcements: DataFrame, news: DataFrame, days_back_news: int = 21,
    days_back_filings: int = 365, max_news: int | None = None,
) -> DataFrame:
    """Landed announcement and RSS payloads -> discovered items.

    News come before announcements. ``arrival`` is built from the fetch time,
    the feed and the position in it (below 2^32, as it is an array place), so
    no company is numbered in one task. It is unique per company as long as a
    feed is fetched once per microsecond. ``feeds.news_limit(days_back_news)``
    is the usual value of ``max_news``; without it all news are read.
    """
    items = feeds.news_items(news, max_items=max_news).withColumn("_feed", F.lit(0)).unionByName(
        feeds.announcements(announcements, days_back=days_back_filings)
        .withColumn("_feed", F.lit(1))
    )
    arrival = F.expr(
        "unix_micros(fetched_at) * CAST(8589934592 AS DECIMAL(18, 0))"
        " + _feed * 4294967296L + feed_pos"
    )
    return items.withColumn("arrival", arrival.cast("decimal(38, 0)")).drop(
        "_feed", "feed_pos"
    )


def keep_new(
    items: DataFrame, news: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Discovered items that are not stored yet, without repeats."""
    stored = dedupe.stored_keys(news, documents)
    return dedupe.two_key_dedupe(items, stored).where("kept").drop("kept")


def news_rows(items: DataFrame) -> DataFrame:
    """Kept news items -> news table rows."""
    title = F.coalesce("headline", "title")
    return items.where("source_type = 'news'").select(
        F.col("content_hash").alias("news_id"), "company_id",
        title.alias("headline"), "summary",
        F.coalesce("publication_date", "fetched_at").alias("published_at"),
        F.coalesce("publisher", F.lit("Auto-discovered"))
        .alias("source_name"),
        F.col("original_url").alias("source_url"),
        T.news_category(F.col("title")).alias("category"),
        F.try_element_at("metadata", F.lit("materiality_score"))
        .try_cast("double").alias("relevance_score"),
        F.lit(False).alias("is_processed"),
    )


def document_rows(items: DataFrame) -> DataFrame:
    """Kept filing items -> document table rows."""
    day = F.to_date("publication_date")
    return items.where("source_type <> 'news'").select(
        F.col("content_hash").alias("document_id"), "company_id", "title",
        F.col("source_type").alias("document_type"),
        day.alias("document_date"), day.alias("publication_date"),
        F.coalesce("financial_year", "quarter").alias("reporting_period"),
        F.col("publisher").alias("source_name"),
        F.col("original_url").alias("source_url"), "document_url",
        F.when(F.col("source_type") == "annual_report", 1).otherwise(2)
        .alias("source_tier"),
        F.lit("pending").alias("text_extraction_status"),
        F.lit("unprocessed").alias("processing_status"),
    )


def onboard(companies: DataFrame, new: DataFrame) -> DataFrame:
    """Company rows to insert for tickers not known yet."""
    return tables.add_missing_companies(companies, new)


def ingest_metrics(
    incoming: DataFrame, stored: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Incoming metrics -> metric table, data-quality rows and rejects."""
    accepted, rejected = facts.admit(incoming)
    return {
        "metrics": facts.store_metrics(accepted, stored),
        "data_quality": facts.metric_conflicts(accepted, stored),
        "rejected": rejected,
    }


def build_document(
    documents: DataFrame, headers: DataFrame
) -> dict[str, DataFrame]:
    """Document text -> pages, page statistics, chunks and previews.

    A document refused by the page statistics keeps its header chunk only.
    """
    pages = C.split_pages(documents)
    stats = C.page_stats(pages)
    good = pages.join(
        stats.where("db_status = 'complete'").select("document_id"),
        "document_id", "left_semi",
    )
    chunks = C.build_chunks(good, headers)
    return {
        "pages": pages,
        "stats": stats,
        "chunks": chunks,
        "previews": C.document_preview(pages, chunks, headers),
    }


def retrieve_evidence(
    chunks: DataFrame, queries: Mapping[str, Sequence[str]] = R.SECTION_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """Evidence packs and their sufficiency gate."""
    packs = retrieve.select_evidence(chunks, queries)
    documents = chunks.select("company_id", "document_id").distinct()
    gate = retrieve.evidence_gate(packs, documents, list(queries))
    return packs, gate


def validate_findings(
    findings: DataFrame, missing: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Notes and the summary of a set of findings."""
    notes = reduce(
        DataFrame.unionByName,
        [qa.finding_notes(findings), qa.contradiction_notes(findings)],
    )
    return {"notes": notes, "summary": qa.qa_summary(findings, notes, missing)}


def validate_conclusions(
    conclusions: DataFrame, packs: DataFrame, chunks: DataFrame,
    sections: DataFrame | None = None,
    scopes: Mapping = R.SECTION_SCOPE,
    subjects: Sequence[Sequence[str]] = W.SUBJECT_PATTERNS,
) -> dict[str, DataFrame]:
    """Accepted and rejected conclusions with the status of every section.

    ``sections`` lists the sections that are asked for; without it, those that
    have conclusions of any verdict count. ``uncertain`` has a row for each
    section that ends up empty.
    """
    judged = K.judge_conclusions(conclusions, packs, chunks, scopes, subjects)
    asked = conclusions.select(*K.SCOPE)
    if sections is not None:
        asked = asked.unionByName(sections.select(*K.SCOPE))
    accepted = judged.where(F.col("reject_reason").isNull())
    status = K.section_status(accepted, sections=asked)
    return {
        "accepted": K.number_survivors(accepted, K.SCOPE, ["pos"]),
        "rejected": judged.where(F.col("reject_reason").isNotNull()),
        "status": status,
        "uncertain": K.uncertain_rows(status),
    }


def assemble_report(
    findings: DataFrame, documents: DataFrame,
    narratives: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Findings -> research rows and evidence rows.

    Without narratives written elsewhere, the plain fallback text is used.
    """
    if narratives is None:
        narratives = report.fallback_narrative(findings).withColumn(
            "tables", F.array().cast("array<string>")
        )
    return {
        "research": report.assemble_sections(narratives, findings),
        "evidence": report.evidence_rows(findings, documents),
    }


__all__ = [
    "assemble_report", "build_document", "discover", "document_rows",
    "ingest_metrics", "keep_new", "news_rows", "onboard",
    "retrieve_evidence", "validate_conclusions", "validate_findings",
]
