"""Document text -> pages -> chunks, and the reads over stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T

SMALL_PAGE = 300
MAX_CHUNK = 8_000
TARGET_CHUNK = 4_000
CUT_SLACK_AFTER = 200
CUT_SLACK_BEFORE = 500
GROUP_PAGES = 3
MIN_PAGE_CHARS = 30
PREVIEW_CHARS = 5_000
PREVIEW_PAGES = 3


def split_pages(documents: DataFrame, separator: str = "\f") -> DataFrame:
    """Document text -> page rows.

    ``documents`` has document_id, company_id, content and page_count (0 when
    unknown). Empty entries at or after the known page count are no pages:
    once the first ``page_count`` entries are numbered, only entries with text
    follow. So an entry's number is its position among the entries kept.
    """
    pieces = F.transform(
        F.split("content", separator), lambda p: T.trim_space(p)
    )
    known = F.slice("pieces", 1, F.greatest("page_count", F.lit(0)))
    later = F.filter(
        "pieces", lambda p, i: (i >= F.col("page_count")) & (p != "")
    )
    return (
        documents.select(
            "document_id", "company_id", "page_count",
            pieces.alias("pieces"),
        )
        .select(
            "document_id", "company_id",
            F.posexplode(F.concat(known, later)).alias("pos", "text"),
        )
        .select(
            "document_id", "company_id",
            (F.col("pos") + 1).alias("page_num"),
            "text",
            T.non_space_length(F.col("text")).alias("char_count"),
        )
        .withColumn("is_empty", F.col("char_count") == 0)
    )


def page_stats(pages: DataFrame) -> DataFrame:
    """Totals and extraction status per document."""
    stats = pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.sum("char_count").alias("total_chars"),
        F.count_if(~F.col("is_empty")).alias("filled_pages"),
        F.count_if("is_empty").alias("empty_pages"),
    )
    status = (
        F.when(
            F.col("total_chars")
            < MIN_PAGE_CHARS * F.greatest("page_count", F.lit(1)),
            "scanned",
        )
        .when(F.col("filled_pages") == 0, "empty")
        .when(F.col("empty_pages") > 0, "partial")
        .otherwise("complete")
    )
    return stats.withColumn("extraction_status", status).withColumn(
        "db_status",
        F.when(
            F.col("extraction_status").isin("complete", "partial"), "complete"
        ).otherwise("failed"),
    )


# ------------------------------------------------------------- chunk building


def split_large(text: Column) -> Column:
    """Parts of a long page: cut after a newline near the target length."""
    steps = F.sequence(
        F.lit(1),
        F.greatest(
            F.lit(1),
            F.ceil(
                F.length(text) / F.lit(TARGET_CHUNK - CUT_SLACK_BEFORE)
            ).cast("int"),
        ),
    )
    window = TARGET_CHUNK + CUT_SLACK_AFTER + 1
    start = F.struct(
        text.alias("rest"), F.array().cast("array<string>").alias("parts")
    )

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, window)
        from_end = F.instr(F.reverse(head), "\n")
        at = F.length(head) - from_end
        near = (from_end > 0) & (at > TARGET_CHUNK - CUT_SLACK_BEFORE)
        cut = F.when(near, at + 1).otherwise(TARGET_CHUNK)
        long = F.length(rest) > MAX_CHUNK
        return F.struct(
            F.when(long, F.substring(rest, cut + 1, F.length(rest)))
            .otherwise(rest).alias("rest"),
            F.when(
                long,
                F.array_append(
                    acc["parts"], F.substring(rest, F.lit(1), cut)
                ),
            ).otherwise(acc["parts"]).alias("parts"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            T.trim_space(acc["rest"]) != "",
            F.array_append(acc["parts"], acc["rest"]),
        ).otherwise(acc["parts"])

    return F.aggregate(steps, start, step, finish)


def _group_starts(marks: Column) -> Column:
    """Per page: first page of its group and the chunk number there.

    ``marks`` is the page-ordered array of (page_num, small, empty, n_parts).
    A small page with text opens a group that takes up to two more pages, as
    long as they are short; an empty page met on its own stands alone.
    """
    start = F.struct(
        F.lit(0).alias("open"),
        F.lit(0).alias("first"),
        F.lit(1).alias("next"),
        F.array().cast("array<struct<first:int,chunk_index:int>>")
        .alias("out"),
    )

    def step(acc: Column, page: Column) -> Column:
        joins = page["short"] & (acc["open"] > 0)
        opens = page["short"] & ~joins & ~page["empty"]
        first = F.when(joins, acc["first"]).otherwise(page["page_num"])
        number = F.when(joins, acc["next"] - 1).otherwise(acc["next"])
        return F.struct(
            F.when(joins, acc["open"] - 1)
            .when(opens, GROUP_PAGES - 1).otherwise(0).alias("open"),
            first.alias("first"),
            F.when(joins, acc["next"])
            .otherwise(acc["next"] + page["n_parts"]).alias("next"),
            F.array_append(
                acc["out"],
                F.struct(first.alias("first"), number.alias("chunk_index")),
            ).alias("out"),
        )

    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def build_chunks(pages: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Page rows -> chunk rows; chunk 0 is the metadata header when given.

    Only page numbers, flags and part counts are gathered per document to
    decide the grouping; page text is moved once, by document, and joined in
    groups of at most three pages. Page numbers are unique per document.
    """
    keys = ["document_id", "company_id"]
    large = F.col("char_count") > MAX_CHUNK
    prepared = pages.withColumn(
        "parts",
        F.when(large, split_large(F.col("text"))).otherwise(F.array("text")),
    )
    mark = F.struct(
        F.col("page_num").alias("page_num"),
        (F.col("char_count") < SMALL_PAGE).alias("short"),
        F.col("is_empty").alias("empty"),
        F.size("parts").alias("n_parts"),
    )
    plan = (
        prepared.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(mark)).alias("marks"))
        .select(
            *keys,
            F.col("marks.page_num").alias("numbers"),
            _group_starts(F.col("marks")).alias("plan"),
        )
    )
    placed = prepared.join(plan, keys).select(
        *keys, "page_num", "text", "is_empty", "parts",
        (F.col("char_count") < SMALL_PAGE).alias("short"),
        F.element_at(
            "plan", F.array_position("numbers", F.col("page_num")).cast("int")
        ).alias("at"),
    )
    groups = placed.groupBy(*keys, "at").agg(
        F.sort_array(
            F.collect_list(
                F.struct("page_num", "text", "is_empty", "parts")
            )
        ).alias("group")
    )
    first = F.col("group")[0]
    n = F.size("group")
    first_page = first["page_num"]
    last_page = F.element_at("group", -1)["page_num"]
    joined = F.array_join(
        F.transform(
            "group",
            lambda p: F.concat(
                F.lit("[Page "), p["page_num"].cast("string"),
                F.lit("]\n"), p["text"],
            ),
        ),
        "\n\n",
    )
    marker = F.concat(
        F.lit("[Page "), first_page.cast("string"),
        F.lit(" — no extractable text]"),
    )
    contents = (
        F.when(n > 1, F.array(joined))
        .when(first["is_empty"], F.array(marker))
        .otherwise(first["parts"])
    )
    label = F.concat(F.lit("Page "), F.col("page_start").cast("string"))
    chunk_label = (
        F.when(
            F.col("n_pages") > 1,
            F.concat(
                F.lit("Pages "), F.col("page_start").cast("string"),
                F.lit("–"), F.col("page_end").cast("string"),
            ),
        )
        .when(F.col("is_empty"), F.concat(label, F.lit(" (empty)")))
        .when(
            F.col("n_parts") > 1,
            F.concat(
                label, F.lit(" (part "),
                (F.col("part") + 1).cast("string"), F.lit("/"),
                F.col("n_parts").cast("string"), F.lit(")"),
            ),
        )
        .otherwise(label)
    )
    chunks = (
        groups.select(
            *keys,
            F.col("at.chunk_index").alias("base"),
            first_page.alias("page_start"),
            last_page.alias("page_end"),
            n.alias("n_pages"),
            ((n == 1) & first["is_empty"]).alias("is_empty"),
            F.size(contents).alias("n_parts"),
            F.posexplode(contents).alias("part", "content"),
        )
        .select(
            *keys,
            (F.col("base") + F.col("part")).alias("chunk_index"),
            "page_start", "page_end",
            F.when(F.col("is_empty"), 0)
            .otherwise(T.non_space_length(F.col("content")))
            .alias("char_count"),
            "content",
            chunk_label.alias("chunk_label"),
        )
    )
    if headers is None:
        return chunks
    zero = F.lit(0)
    return chunks.unionByName(
        headers.select(
            *keys,
            zero.alias("chunk_index"), zero.alias("page_start"),
            zero.alias("page_end"),
            T.non_space_length(F.col("header")).alias("char_count"),
            F.col("header").alias("content"),
            F.lit("Metadata").alias("chunk_label"),
        )
    )


def document_preview(
    pages: DataFrame, chunks: DataFrame, headers: DataFrame
) -> DataFrame:
    """Metadata header, the first pages up to a length, and a pointer line."""
    keys = ["document_id", "company_id"]
    counts = pages.groupBy(*keys).agg(F.count("*").alias("n_pages"))
    n_chunks = chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"))
    firsts = (
        pages.where(F.col("page_num") <= PREVIEW_PAGES)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("page_num", "text")))
            .alias("pages")
        )
    )
    rows = (
        headers.join(counts, keys, "left").join(n_chunks, keys, "left")
        .join(firsts, keys, "left")
        .na.fill(0, ["n_pages", "n_chunks"])
    )
    begin = F.struct(
        F.concat(F.col("header"), F.lit("\n\n")).alias("text"),
        F.lit(False).alias("full"),
    )

    def step(acc: Column, page: Column) -> Column:
        head = F.concat(
            F.lit("[PAGE "), page["page_num"].cast("string"), F.lit(" / "),
            F.col("n_pages").cast("string"), F.lit(" — preview]\n"),
        )
        whole = F.concat(acc["text"], head, page["text"], F.lit("\n\n"))
        left = PREVIEW_CHARS - F.length(acc["text"]) - F.length(head) - 4
        cut = F.when(
            left > 100,
            F.concat(
                acc["text"], head, F.substring(page["text"], F.lit(1), left),
                F.lit("…\n"),
            ),
        ).otherwise(acc["text"])
        over = F.length(whole) > PREVIEW_CHARS
        return F.when(acc["full"], acc).otherwise(
            F.struct(
                F.when(over, cut).otherwise(whole).alias("text"),
                over.alias("full"),
            )
        )

    listed = F.coalesce(
        F.col("pages"), F.array().cast("array<struct<page_num:int,text:string>>")
    )
    body = F.aggregate(listed, begin, step, lambda acc: acc["text"])
    pointer = F.concat(
        F.lit("[CHUNKED — "), F.col("n_chunks").cast("string"),
        F.lit(" chunks ("), F.col("n_pages").cast("string"),
        F.lit(" pages); the full text is in the chunk table.]\n"),
    )
    return rows.select(*keys, F.concat(body, pointer).alias("preview"))


# ----------------------------------------------------------------- chunk reads


def chunk_range(
    chunks: DataFrame,
    document_id: object,
    page_from: int | None = None,
    page_to: int | None = None,
    chunk_indexes: list[int] | None = None,
    limit: int | None = None,
    include_metadata: bool = False,
) -> DataFrame:
    """Ordered chunks of one document.

    An index list takes the place of the filter that skips the header.
    """
    rows = chunks.where(F.col("document_id") == document_id)
    if chunk_indexes:
        rows = rows.where(F.col("chunk_index").isin(chunk_indexes))
    elif not include_metadata:
        rows = rows.where(F.col("chunk_index") > 0)
    if page_from is not None:
        rows = rows.where(F.col("page_start") >= page_from)
    if page_to is not None:
        rows = rows.where(F.col("page_end") <= page_to)
    rows = rows.orderBy("chunk_index")
    return rows if limit is None else rows.limit(limit)


def search_chunks(
    chunks: DataFrame,
    documents: DataFrame,
    query: str,
    company_id: object | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Case-insensitive keyword search over chunks, with document titles.

    With a limit, hits are cut to it before the title join, so the join sees
    at most that many rows.
    """
    needle = query.strip()
    rows = chunks.where(F.col("chunk_index") > 0)
    if company_id is not None:
        rows = rows.where(F.col("company_id") == company_id)
    if len(needle) < 2:
        rows = rows.where(F.lit(False))
    hits = rows.where(F.contains(F.lower("content"), F.lit(needle.lower())))
    if limit is not None:
        hits = hits.orderBy("chunk_index", "document_id").limit(limit)
    return with_titles(hits, documents)


def with_titles(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Add document titles; unknown documents get a placeholder."""
    titles = documents.select("document_id", F.col("title").alias("_title"))
    return (
        hits.join(titles, "document_id", "left")
        .withColumn("document_title", F.coalesce("_title", F.lit("(unknown)")))
        .drop("_title")
    )


def missing_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages 1..N of each document that no chunk covers."""
    covered = chunks.where(F.col("chunk_index") > 0).select(
        "document_id",
        F.explode(F.sequence("page_start", "page_end")).alias("page_num"),
    )
    wanted = documents.where(F.col("page_count") > 0).select(
        "document_id",
        F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int")))
        .alias("page_num"),
    )
    return wanted.join(covered, ["document_id", "page_num"], "left_anti")


def contiguity(chunks: DataFrame) -> DataFrame:
    """Do a document's chunk indexes run 0..n-1 without gaps or repeats?

    Chunk indexes that are distinct, start at 0 and end at n-1 are exactly
    the row positions, so three aggregates replace a numbering window.
    """
    return (
        chunks.groupBy("document_id")
        .agg(
            F.count("*").alias("n_chunks"),
            F.min("chunk_index").alias("first_index"),
            F.max("chunk_index").alias("last_index"),
            F.count_distinct("chunk_index").alias("n_distinct"),
        )
        .withColumn(
            "contiguous",
            (F.col("first_index") == 0)
            & (F.col("last_index") == F.col("n_chunks") - 1)
            & (F.col("n_distinct") == F.col("n_chunks")),
        )
    )
