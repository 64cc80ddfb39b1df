"""Landed feed payloads -> rows.

Each reader takes a ``raw_feed`` table (one payload per row) and parses the
payload text with built-in JSON and regex functions. A payload that is empty,
an HTML page or malformed yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill import schemas
from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.functions.rows import compute_once, explode_rows
from filingmill.rules import metrics as M
from filingmill.rules import words as W

PDF_BASE = "https://www.bseindia.com/xml-data/corpfiling/AttachHis/"
LIVE_BASE = "https://www.bseindia.com/xml-data/corpfiling/AttachLive/"
DETAIL_BASE = "https://www.bseindia.com/corporates/anndet_new.aspx?newsid="


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _fetched(raw: DataFrame) -> DataFrame:
    body = T.trim_space(F.col("payload"))
    return raw.where(
        F.col("http_status").between(200, 299)
        & (body != "")
        & (body != '"No Record Found!"')
        & ~body.startswith("<")
    )


def payload_time(c: Column) -> Column:
    """Timestamp of an ISO text or an RFC-822 date, NULL when neither."""
    rfc = F.regexp_extract(
        c, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1
    )
    return F.coalesce(
        F.try_to_timestamp(c),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")),
    )


def announcements(
    raw: DataFrame, days_back: int | None = None,
    max_items: int | None = None,
) -> DataFrame:
    """Exchange announcements -> discovered items.

    With ``max_items``, only the first rows of each payload are read, in feed
    order and before any filter.
    """
    row = F.col("item")
    parsed = explode_rows(
        _fetched(raw), ["company_id", "fetched_at"],
        F.from_json("payload", schemas.ANNOUNCEMENTS)["Table"],
        "item", "feed_pos",
    )
    subject = T.trim_space(
        F.coalesce(row["NEWSSUB"], row["HEADLINE"], F.lit(""))
    )
    name = _filled(T.trim_space(row["ATTACHMENTNAME"]))
    detail = F.concat(F.lit(DETAIL_BASE), _text(row["NEWSID"]))
    if max_items is not None:
        parsed = parsed.where(F.col("feed_pos") < max_items)
    items = (
        compute_once(parsed, title=subject)
        .where(F.col("title") != "")
        .where(T.is_material_announcement(row["CATEGORYNAME"], F.col("title")))
        .select(
            "company_id", "fetched_at", "feed_pos",
            T.announcement_type(F.col("title"), row["CATEGORYNAME"])
            .alias("source_type"),
            "title",
            F.col("title").alias("headline"),
            F.concat_ws(
                " · ", _filled(row["CATEGORYNAME"]),
                _filled(row["SUBCATNAME"]), _filled(row["MORE"]),
            ).alias("summary"),
            payload_time(
                F.coalesce(_filled(row["DT_TM"]), _filled(row["NEWS_DT"]))
            ).alias("publication_date"),
            F.lit("BSE India").alias("publisher"),
            detail.alias("original_url"),
            F.concat(F.lit(PDF_BASE), name).alias("document_url"),
            T.title_quarter(F.col("title")).alias("quarter"),
            T.title_year(F.col("title")).alias("financial_year"),
            T.content_hash(detail, F.col("title")).alias("content_hash"),
            F.create_map(
                F.lit("news_id"), row["NEWSID"],
                F.lit("scrip_code"), row["SCRIP_CD"].cast("string"),
                F.lit("category"), row["CATEGORYNAME"],
                F.lit("sub_category"), row["SUBCATNAME"],
            ).alias("metadata"),
        )
    )
    if days_back is not None:
        oldest = F.col("fetched_at") - F.make_dt_interval(F.lit(days_back))
        items = items.where(
            F.col("publication_date").isNull()
            | (F.col("publication_date") >= oldest)
        )
    return items


def news_limit(days_back: int) -> int:
    """News items read per run."""
    return max(20, min(60, days_back * 2))


def rss_items(raw: DataFrame) -> DataFrame:
    """RSS payload -> title, link, publisher, time, summary per item."""
    block = F.col("item")

    def tag(name: str) -> Column:
        body = F.regexp_extract(
            block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1
        )
        return T.trim_space(T.decode_entities(body))

    blocks = explode_rows(
        raw.where(F.col("http_status").between(200, 299)),
        ["company_id", "fetched_at"],
        F.regexp_extract_all(
            "payload", F.lit(r"(?s)<item[^>]*>(.*?)</item>"), 1
        ),
        "item", "block_pos",
    )
    items = compute_once(
        blocks,
        title=tag("title"),
        link=tag("link"),
        publisher=tag("source"),
        published_text=tag("pubDate"),
        summary=T.visible_text(tag("description")),
    )
    return items.drop("item").where(
        (F.col("title") != "") & (F.col("link") != "")
    )


def news_items(
    raw: DataFrame, max_items: int | None = None,
    min_score: float = W.NEWS_MIN_SCORE,
) -> DataFrame:
    """RSS payload -> material news as discovered items.

    One payload is one row, so ``max_items`` counts its items inside the row's
    feed; ``feed_pos`` is the place in the payload.
    """
    items = rss_items(raw).withColumnRenamed("block_pos", "feed_pos")
    if max_items is not None:
        feed = Window.partitionBy("company_id", "fetched_at").orderBy("feed_pos")
        items = (
            items.withColumn("_rn", F.row_number().over(feed))
            .where(F.col("_rn") <= max_items).drop("_rn")
        )
    items = compute_once(items, _text=T.news_text(F.col("title"), F.col("summary")))
    return (
        compute_once(items, score=T.text_materiality(F.col("_text")))
        .where(F.col("score") >= min_score)
        .select(
            "company_id", "fetched_at", "feed_pos",
            F.lit("news").alias("source_type"),
            "title",
            F.col("title").alias("headline"),
            _filled(F.col("summary")).alias("summary"),
            payload_time(F.col("published_text")).alias("publication_date"),
            F.coalesce(_filled(F.col("publisher")), F.lit("Google News"))
            .alias("publisher"),
            F.col("link").alias("original_url"),
            F.lit(None).cast("string").alias("document_url"),
            F.lit(None).cast("string").alias("quarter"),
            F.lit(None).cast("string").alias("financial_year"),
            T.content_hash(F.col("link"), F.col("title"))
            .alias("content_hash"),
            F.create_map(
                F.lit("materiality_score"), F.col("score").cast("string")
            ).alias("metadata"),
        )
    )


def _filing(
    exchange: str, method: str, filing_type: Column, period: Column,
    date: Column, title: Column, filing_id: Column, url: Column,
    xbrl_url: Column,
) -> list:
    return [
        "company_id",
        filing_type.alias("filing_type"),
        _text(period).alias("filing_period"),
        _text(date).alias("filing_date_text"),
        F.lit(exchange).alias("source_exchange"),
        F.lit(1).alias("source_tier"),
        F.lit(method).alias("discovery_method"),
        _text(title).alias("filing_title"),
        _text(filing_id).alias("exchange_filing_id"),
        url.alias("filing_url"),
        url.alias("document_url"),
        xbrl_url.alias("xbrl_url"),
        (_text(xbrl_url) != "").alias("xbrl_available"),
    ]


def listed_filings(raw: DataFrame) -> DataFrame:
    """Exchange A announcement list -> filings."""
    r = F.col("item")
    rows = explode_rows(
        _fetched(raw), ["company_id"],
        F.from_json("payload", schemas.LISTED_FILINGS), "item",
    )
    kind = F.coalesce(
        T.map_value(
            M.EXCHANGE_A_TYPES, _text(F.coalesce(r["subject"], r["category"]))
        ),
        F.lit("other_filing"),
    )
    return rows.select(
        *_filing(
            "NSE", "nse_rss", kind, r["period"],
            F.coalesce(r["date"], r["timestamp"]),
            F.coalesce(r["subject"], r["desc"]),
            F.coalesce(r["recordId"], r["id"]),
            r["attchmntFile"], F.lit(None).cast("string"),
        )
    )


def result_filings(raw: DataFrame) -> DataFrame:
    """Exchange A results list (an array, or an object holding ``results``)."""
    r = F.col("item")
    is_array = T.trim_space(F.col("payload")).startswith("[")
    inner = F.get_json_object("payload", "$.results")
    text = F.when(is_array, F.col("payload")).otherwise(inner)
    rows = explode_rows(
        _fetched(raw), ["company_id"],
        F.from_json(text, schemas.RESULT_FILINGS), "item",
    )
    return rows.select(
        *_filing(
            "NSE", "nse_api", F.lit("quarterly_result"), r["period"],
            F.coalesce(r["xbrl_date"], r["date"]), r["desc"], r["seqno"],
            r["xbrl"], r["xbrl"],
        )
    )


def exchange_b_filings(raw: DataFrame) -> DataFrame:
    """Exchange B filings list -> filings; attachments become URLs."""
    r = F.col("item")
    rows = explode_rows(
        _fetched(raw), ["company_id"],
        F.from_json("payload", schemas.EXCHANGE_B_FILINGS)["Table"], "item",
    )
    kind = F.coalesce(
        T.map_value(
            M.EXCHANGE_B_TYPES,
            _text(F.coalesce(r["CATEGORYNAME"], r["Category"])),
        ),
        F.lit("other_filing"),
    )
    return rows.select(
        *_filing(
            "BSE", "bse_api", kind, r["PERIOD"],
            F.coalesce(r["FILLINGDATE"], r["DATE"]), r["HEADLINE"],
            r["NEWSID"], F.concat(F.lit(LIVE_BASE), r["ATTACHMENTNAME"]),
            F.lit(None).cast("string"),
        )
    )


def all_filings(*feeds: DataFrame) -> DataFrame:
    """Union of the filings of every source that answered."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def result_periods(raw: DataFrame) -> DataFrame:
    """Results-comparison payload -> one wide row per period."""
    r = F.col("item")
    rows = explode_rows(
        _fetched(raw), ["company_id"],
        F.from_json("payload", schemas.RESULTS)["resCmpData"], "item",
    ).where((_text(r["re_from_dt"]) != "") & (_text(r["re_to_dt"]) != ""))
    notes = F.concat_ws(
        " ", _text(r["re_desc_note_fin"]), _text(r["re_desc_note_seg"])
    )

    def number(name: str) -> Column:
        return T.leading_number(r[name])

    return rows.select(
        "company_id",
        calc.fiscal_period(
            r["re_from_dt"], r["re_to_dt"], r["re_res_type"]
        ).alias("period"),
        F.when(r["re_res_type"] == "A", "Audited").otherwise("Unaudited")
        .alias("audit_status"),
        T.detect_basis(notes).alias("accounting_basis"),
        number("re_net_sale").alias("net_sale"),
        number("re_net_profit").alias("net_profit"),
        number("re_oth_inc_new").alias("other_income"),
        number("re_pro_loss_bef_tax").alias("pbt"),
        number("re_depr_und_exp").alias("depreciation"),
        number("re_int_new").alias("finance_cost"),
        F.coalesce(
            number("re_basic_eps"), number("re_basic_eps_for_cont_dic_opr")
        ).alias("eps"),
    )


def shareholding_keys(raw: DataFrame) -> DataFrame:
    """Shareholding payload -> its top-level keys, reported as quarters."""
    return explode_rows(
        _fetched(raw), ["company_id"], F.json_object_keys("payload"), "quarter"
    )
