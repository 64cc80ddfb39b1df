"""Queries on companies, feeds, the queue and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.operators import facts, report, views
from filingmill.plans.catalog import query
from filingmill.rules import metrics as M
from filingmill.rules import research as R
from filingmill.rules import words as W
from filingmill.session import fixed_table
from filingmill.sources import feeds, tables
from filingmill.sources import testviews as V

COMPANIES_SQL = """
companies AS (SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS name,
  'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ticker, r_name AS exchange,
  n_name || ' / ' || r_name AS short_description, s_acctbal > 0 AS is_active,
  CAST(n_nationkey AS VARCHAR) AS parent_company_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ------------------------------------------------------------------- companies


@query(
    "name_search",
    f"""WITH {COMPANIES_SQL}, a AS (SELECT *, 0 AS side FROM companies WHERE contains(lower(name), '00001')
      ORDER BY name, company_id LIMIT 10), b AS (SELECT *, 1 AS side FROM companies
      WHERE contains(lower(ticker), '00001') ORDER BY name, company_id LIMIT 10)
    SELECT company_id, name, ticker, exchange, short_description, CAST(min(side) AS INTEGER) AS side
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"),
)
def name_search(spark, sf_dir) -> DataFrame:
    """Name hits, then ticker hits, of a search term with wildcards in it."""
    return views.search_companies(V.companies(spark, sf_dir), " %00001* ")


@query(
    "directory",
    f"""WITH {COMPANIES_SQL} SELECT company_id, name, ticker, exchange, short_description
    FROM companies WHERE is_active ORDER BY name, company_id LIMIT 200""",
)
def directory(spark, sf_dir) -> DataFrame:
    """Active companies by name."""
    return views.directory(V.companies(spark, sf_dir))


@query(
    "research_join",
    f"""WITH {COMPANIES_SQL} SELECT c.company_id, c.name, c.ticker, o.o_orderkey AS research_id,
      o.o_orderpriority AS section FROM companies c JOIN orders o
      ON CAST(o.o_custkey AS VARCHAR) = c.company_id WHERE c.ticker = 'S000042'""",
)
def research_join(spark, sf_dir) -> DataFrame:
    """Report rows of one company, found by an untidy ticker."""
    research = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"),
        F.col("o_orderkey").alias("research_id"),
        F.col("o_orderpriority").alias("section"),
        F.col("o_orderdate").alias("created_at"),
    )
    return views.company_research(
        V.companies(spark, sf_dir), research, " s0000 42"
    ).drop("created_at")


@query(
    "company_parent",
    f"""WITH {COMPANIES_SQL} SELECT c.company_id, c.name, c.parent_company_id, p.name AS parent_name
    FROM companies c LEFT JOIN companies p ON p.company_id = c.parent_company_id""",
)
def company_parent(spark, sf_dir) -> DataFrame:
    """Each company with its parent's name."""
    return views.with_parent(V.companies(spark, sf_dir)).select(
        "company_id", "name", "parent_company_id", "parent_name"
    )


_CODES = list(M.EXCHANGE_CODES)


@query(
    "exchange_code",
    f"""WITH t AS (SELECT s_suppkey AS company_id, CASE WHEN s_acctbal > 0
        THEN {_sql_list(_CODES)}[CAST(s_suppkey % 14 AS INTEGER) + 1] ELSE s_name END AS ticker FROM supplier)
    SELECT company_id, ticker, c.code AS exchange_code,
      CASE WHEN c.code IS NULL THEN 'No exchange code for ticker ' || ticker END AS exchange_error
    FROM t LEFT JOIN (SELECT unnest({_sql_list(_CODES)}) AS k, unnest({_sql_list(M.EXCHANGE_CODES.values())}) AS code) c
      ON c.k = upper(ticker)""",
)
def exchange_code(spark, sf_dir) -> DataFrame:
    """Exchange code of each ticker, with a note where none is known."""
    listed = F.array(*[F.lit(c) for c in _CODES])
    pick = F.get(listed, (F.col("s_suppkey") % 14).cast("int"))
    rows = V.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("company_id"),
        F.when(F.col("s_acctbal") > 0, pick).otherwise(F.col("s_name"))
        .alias("ticker"),
    )
    return views.exchange_codes(rows)


_INDUSTRIES = {
    "STANDARD": ("Housing Finance", "bank"),
    "ECONOMY": ("Auto parts", "manufacturing"),
    "SMALL": ("Diversified holding", "conglomerate"),
    "MEDIUM": ("Retail", "default"),
    "LARGE": ("Software", "it_services"),
    "PROMO": ("Road construction", "epc"),
}


@query(
    "framework_choice",
    "SELECT p_partkey AS company_id, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _INDUSTRIES.items())
    + " END AS framework FROM part",
)
def framework_choice(spark, sf_dir) -> DataFrame:
    """Industry framework of a company."""
    industry = T.map_value({k: v[0] for k, v in _INDUSTRIES.items()}, F.col("p_type"))
    return V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("company_id"),
        T.choose_framework(
            industry, F.col("p_name"), F.lit(None).cast("string"),
            R.FRAMEWORK_WORDS,
        ).alias("framework"),
    )


# ------------------------------------------------------------- headline scalars

_KW_SCORE = f"""least(1.0, 0.1 + 0.08 * len(list_filter({_sql_list(W.NEWS_KEYWORDS)}, lambda k: contains(t, k)))
  + CASE WHEN regexp_matches(t, '₹\\s?[\\d,]{{4,}}') THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(t, '\\b(crore|billion|million)\\b') THEN 0.06 ELSE 0 END)"""


@query(
    "materiality",
    f"""WITH {V.HEADLINES_SQL}, s AS (SELECT item_id, lower(title || ' ' || summary) AS t FROM headlines)
    SELECT item_id, round(CAST({_KW_SCORE} AS DOUBLE), 6) AS score, {_KW_SCORE} >= 0.18 AS kept FROM s""",
)
def materiality(spark, sf_dir) -> DataFrame:
    """News materiality score and whether the item is kept."""
    score = T.news_materiality(F.col("title"), F.col("summary"))
    return V.headlines(spark, sf_dir).select("item_id", score.alias("s")).select(
        "item_id", F.round("s", 6).alias("score"),
        (F.col("s") >= W.NEWS_MIN_SCORE).alias("kept"),
    )


@query(
    "classify_item",
    f"""WITH {V.HEADLINES_SQL}
    SELECT item_id, len(list_filter({_sql_list(W.MATERIAL_CATEGORIES)}, lambda k: contains(category, k))) > 0
        OR len(list_filter({_sql_list(W.MATERIAL_SUBJECT_WORDS)}, lambda k: contains(lower(title), k))) > 0 AS material,
      CASE WHEN contains(lower(title), 'earnings call transcript') THEN 'concall'
        WHEN contains(lower(title), 'credit rating') OR category = 'Credit Rating' THEN 'credit_rating'
        ELSE 'filing' END AS source_type
    FROM headlines""",
)
def classify_item(spark, sf_dir) -> DataFrame:
    """Material announcements and their type."""
    return V.headlines(spark, sf_dir).select(
        "item_id",
        T.is_material_announcement(F.col("category"), F.col("title"))
        .alias("material"),
        T.announcement_type(F.col("title"), F.col("category"))
        .alias("source_type"),
    )


@query(
    "category",
    f"""WITH {V.HEADLINES_SQL}, t AS (SELECT item_id, lower(title || ' ' || summary) AS t FROM headlines)
    SELECT item_id, CASE WHEN contains(t, 'rating') THEN 'Credit'
      WHEN contains(t, 'result') OR contains(t, 'earnings') THEN 'Results'
      WHEN contains(t, 'order') THEN 'Business' WHEN contains(t, 'regulator') THEN 'Regulatory'
      WHEN contains(t, 'dividend') THEN 'Capital Returns' ELSE 'General' END AS category FROM t""",
)
def category(spark, sf_dir) -> DataFrame:
    """News category of each headline."""
    text = F.concat_ws(" ", "title", "summary")
    return V.headlines(spark, sf_dir).select(
        "item_id", T.news_category(text).alias("category")
    )


@query(
    "content_hash",
    f"""WITH {V.HEADLINES_SQL}, t AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS n FROM headlines)
    SELECT item_id, n AS normal_title, left(sha256(url || '::' || n), 32) AS content_hash FROM t""",
)
def content_hash(spark, sf_dir) -> DataFrame:
    """Normalised title and content hash."""
    return V.headlines(spark, sf_dir).select(
        "item_id", T.normalise_title(F.col("title")).alias("normal_title"),
        T.content_hash(F.col("url"), F.col("title")).alias("content_hash"),
    )


@query(
    "period_from_title",
    """SELECT o_orderkey AS item_id,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) || 'FY'
        || right(CAST(year(o_orderdate) AS VARCHAR), 2) END AS quarter,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2)
        WHEN '3-MEDIUM' THEN 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-'
          || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2) END AS financial_year
    FROM orders""",
)
def period_from_title(spark, sf_dir) -> DataFrame:
    """Quarter and year named in each headline."""
    return V.headlines(spark, sf_dir).select(
        "item_id", T.title_quarter(F.col("title")).alias("quarter"),
        T.title_year(F.col("title")).alias("financial_year"),
    )


_BASIS = {
    "STANDARD": ("Statement of standalone results", "STANDALONE"),
    "ECONOMY": ("Unconsolidated", "STANDALONE"),
    "SMALL": ("unconsolidated financial statement", None),
    "MEDIUM": ("standalone and consolidated", None),
    "LARGE": ("Results (Consolidated)", "CONSOLIDATED"),
    "PROMO": ("", None),
}


@query(
    "basis_detect",
    "SELECT p_partkey AS row_id, CASE p_type "
    + " ".join(
        f"WHEN '{k}' THEN {'NULL' if v[1] is None else repr(v[1])}"
        for k, v in _BASIS.items()
    )
    + " END AS accounting_basis FROM part",
)
def basis_detect(spark, sf_dir) -> DataFrame:
    """Accounting basis named in a text."""
    text = F.concat_ws(
        " ", "p_name", T.map_value({k: v[0] for k, v in _BASIS.items()}, F.col("p_type")),
        "p_brand",
    )
    return V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        T.detect_basis(text).alias("accounting_basis"),
    )


# -------------------------------------------------------------- landed payloads

_RSS = """'<rss><channel><title>Feed</title><item><title><![CDATA[' || title || ']]></title><link>' || url
  || '</link><source url="x">Daily &amp;amp; News</source><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate>'
  || '<description>&lt;a href="x"&gt;' || summary || '&lt;/a&gt;  more</description></item>'
  || '<item><title>No link</title></item></channel></rss>'"""


@query(
    "rss_news",
    f"""WITH {V.HEADLINES_SQL}, s AS (SELECT *, trim(summary || ' more') AS d,
        lower(title || ' ' || trim(regexp_replace(' ' || summary || ' more', '\\s+', ' ', 'g'))) AS t FROM headlines)
    SELECT item_id, title, url AS original_url, trim(regexp_replace(summary || '   more', '\\s+', ' ', 'g')) AS summary,
      'Daily &amp; News' AS publisher, '2025-01-06 10:00:00' AS published,
      left(sha256(url || '::' || trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))), 32) AS content_hash
    FROM s WHERE {_KW_SCORE} >= 0.18""",
)
def rss_news(spark, sf_dir) -> DataFrame:
    """One RSS payload per order -> material news items."""
    raw = V.headlines(spark, sf_dir).select(
        F.col("item_id").alias("company_id"),
        F.col("published_at").alias("fetched_at"),
        F.lit(200).alias("http_status"), F.expr(_RSS).alias("payload"),
    )
    return feeds.news_items(raw).select(
        F.col("company_id").alias("item_id"), "title", "original_url",
        "summary", "publisher",
        F.date_format("publication_date", "yyyy-MM-dd HH:mm:ss")
        .alias("published"),
        "content_hash",
    )


@query(
    "announcement_feed",
    f"""WITH {V.HEADLINES_SQL}
    SELECT item_id, trim(title) AS title, concat_ws(' · ', category, nullif(summary, '')) AS summary,
      CASE WHEN contains(lower(title), 'earnings call transcript') THEN 'concall'
        WHEN contains(lower(title), 'credit rating') OR category = 'Credit Rating' THEN 'credit_rating'
        ELSE 'filing' END AS source_type,
      strftime(published_at, '%Y-%m-%d') AS published,
      'https://www.bseindia.com/xml-data/corpfiling/AttachHis/' || company_id || '.pdf' AS document_url
    FROM headlines WHERE len(list_filter({_sql_list(W.MATERIAL_CATEGORIES)}, lambda k: contains(category, k))) > 0
        OR len(list_filter({_sql_list(W.MATERIAL_SUBJECT_WORDS)}, lambda k: contains(lower(title), k))) > 0""",
)
def announcement_feed(spark, sf_dir) -> DataFrame:
    """One announcement payload per order -> discovered items."""
    item = F.struct(
        F.col("item_id").cast("string").alias("NEWSID"),
        F.when(F.col("category") == "Board Meeting", F.col("title"))
        .alias("NEWSSUB"),
        F.col("title").alias("HEADLINE"),
        F.when(F.col("category") == "Board Meeting", "").otherwise(
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
        ).alias("DT_TM"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("NEWS_DT"),
        F.col("category").alias("CATEGORYNAME"),
        F.lit("").alias("SUBCATNAME"), F.col("summary").alias("MORE"),
        F.concat(F.lit(" "), "company_id", F.lit(".pdf "))
        .alias("ATTACHMENTNAME"),
    )
    blank = F.struct(F.lit("0").alias("NEWSID"), F.lit(" ").alias("NEWSSUB"))
    payload = F.concat(
        F.lit('{"Table":['), F.to_json(blank), F.lit(","), F.to_json(item),
        F.lit("]}"),
    )
    raw = V.headlines(spark, sf_dir).select(
        F.col("item_id").alias("company_id"),
        F.col("published_at").alias("fetched_at"),
        F.lit(200).alias("http_status"), payload.alias("payload"),
    )
    return feeds.announcements(raw).select(
        F.col("company_id").alias("item_id"), "title", "summary",
        "source_type",
        F.date_format("publication_date", "yyyy-MM-dd").alias("published"),
        "document_url",
    )


@query(
    "filing_feeds",
    """SELECT o_orderkey AS company_id, 'NSE' AS source_exchange, 'nse_rss' AS discovery_method,
        CASE o_orderstatus WHEN 'F' THEN 'quarterly_result' ELSE 'other_filing' END AS filing_type,
        CASE o_orderstatus WHEN 'F' THEN 'Financial Results' ELSE 'Notice' END AS filing_title,
        '' AS filing_period, 'http://x/' || o_custkey AS filing_url, false AS xbrl_available FROM orders
      UNION ALL SELECT o_orderkey, 'NSE', 'nse_api', 'quarterly_result', 'Results', 'Q1',
        CASE o_orderstatus WHEN 'F' THEN '' ELSE 'http://y/' || o_custkey END, o_orderstatus <> 'F' FROM orders
      UNION ALL SELECT o_orderkey, 'BSE', 'bse_api', CASE o_orderstatus WHEN 'O' THEN 'brsr' ELSE 'other_filing' END,
        'Head', 'P', 'https://www.bseindia.com/xml-data/corpfiling/AttachLive/' || o_custkey || '.pdf', false FROM orders""",
)
def filing_feeds(spark, sf_dir) -> DataFrame:
    """Three exchange lists per order -> one filing table."""
    orders = V.keyed_orders(spark, sf_dir)
    key, cust, status = (
        F.col("o_orderkey"), F.col("o_custkey").cast("string"),
        F.col("o_orderstatus"),
    )

    def raw(payload) -> DataFrame:
        return orders.select(
            key.alias("company_id"), F.lit(200).alias("http_status"),
            payload.alias("payload"),
        )

    listed = F.struct(
        F.when(status == "F", "Financial Results").alias("subject"),
        F.lit("Financial Results ").alias("category"),
        F.lit("Notice").alias("desc"),
        F.concat(F.lit("http://x/"), cust).alias("attchmntFile"),
    )
    result = F.struct(
        F.lit("Q1").alias("period"), F.lit("Results").alias("desc"),
        F.when(status == "F", "").otherwise(F.concat(F.lit("http://y/"), cust))
        .alias("xbrl"),
    )
    wrapped = F.when(status == "P", F.to_json(F.array(result))).otherwise(
        F.to_json(F.struct(F.array(result).alias("results")))
    )
    b_row = F.struct(
        F.when(status == "O", "BRSR").otherwise("x").alias("CATEGORYNAME"),
        F.lit("P").alias("PERIOD"), F.lit("Head").alias("HEADLINE"),
        F.concat(cust, F.lit(".pdf")).alias("ATTACHMENTNAME"),
    )
    return feeds.all_filings(
        feeds.listed_filings(raw(F.to_json(F.array(listed)))),
        feeds.result_filings(raw(wrapped)),
        feeds.exchange_b_filings(
            raw(F.to_json(F.struct(F.array(b_row).alias("Table"))))
        ),
    ).select(
        "company_id", "source_exchange", "discovery_method", "filing_type",
        "filing_title", "filing_period", "filing_url", "xbrl_available",
    )


@query(
    "shareholding_keys",
    """SELECT event_id AS company_id, k AS quarter FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)""",
)
def shareholding_keys(spark, sf_dir) -> DataFrame:
    """Top-level keys of a JSON payload."""
    raw = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("company_id"), F.lit(200).alias("http_status"),
        F.col("props").alias("payload"),
    )
    return feeds.shareholding_keys(raw)


@query(
    "fetch_outcome",
    """SELECT o_orderkey AS fetch_id, r AS reason, CASE WHEN r IS NULL THEN 'complete'
        WHEN r IN ('NETWORK_BLOCKED', 'AUTH_REQUIRED') THEN 'blocked' ELSE 'failed' END AS status
    FROM (SELECT o_orderkey, CASE month(o_orderdate) WHEN 1 THEN 'AUTH_REQUIRED' WHEN 2 THEN 'AUTH_REQUIRED'
      WHEN 3 THEN 'NOT_FOUND' WHEN 4 THEN 'RATE_LIMITED' WHEN 5 THEN 'ENDPOINT_CHANGED'
      WHEN 6 THEN 'SOURCE_UNREACHABLE' WHEN 7 THEN 'UNKNOWN'
      WHEN 8 THEN CASE o_orderstatus WHEN 'F' THEN 'SOURCE_UNREACHABLE' WHEN 'O' THEN 'NETWORK_BLOCKED' ELSE 'UNKNOWN' END
      END AS r FROM orders)""",
)
def fetch_outcome(spark, sf_dir) -> DataFrame:
    """Failure class and retrieval status of fetch-log rows."""
    codes = {1: 401, 2: 403, 3: 404, 4: 429, 5: 302, 6: 503, 7: 418}
    month = F.month("o_orderdate")
    status = F.when(
        month != 8,
        F.coalesce(F.try_element_at(
            F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), month
        ), F.lit(200)),
    )
    error = F.when(F.col("o_orderstatus") == "F", "AbortError").when(
        F.col("o_orderstatus") == "O", "ENOTFOUND"
    )
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fetch_id"),
        T.fetch_failure(status, error).alias("reason"),
    )
    return rows.withColumn("status", T.retrieval_status(F.col("reason")))


# ------------------------------------------------------------------------ feed

FEED_SQL = """
nw AS (SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS company_id, CAST(event_id AS VARCHAR) AS item_id,
    event_type || ' ' || props AS title, CASE WHEN event_type <> 'error' THEN ts END AS published_at,
    event_type AS category, row_number() OVER (PARTITION BY user_id ORDER BY
      CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, CAST(event_id AS VARCHAR)) AS rn FROM events)),
dc AS (SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderkey AS VARCHAR) AS item_id,
    'Order ' || o_orderkey AS title,
    o_orderdate AS published_at, CASE o_orderpriority WHEN '1-URGENT' THEN 'Annual_Report' WHEN '2-HIGH' THEN 'concall'
      WHEN '3-MEDIUM' THEN 'unknown' WHEN '4-NOT SPECIFIED' THEN 'credit_rating' END AS category,
    row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END
      DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders)),
items AS (SELECT company_id, item_id, 'news' AS source_type, title, published_at, category FROM nw
  UNION ALL SELECT company_id, item_id, CASE WHEN lower(category) IN ('annual_report', 'concall', 'credit_rating')
    THEN lower(category) ELSE 'filing' END, title, published_at, category FROM dc)"""


@query(
    "feed_union",
    f"""WITH {FEED_SQL}, {COMPANIES_SQL}
    SELECT i.company_id, c.ticker, item_id, source_type, title, category,
      strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published,
      CAST(row_number() OVER (PARTITION BY i.company_id ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01') DESC,
        source_type, item_id) AS INTEGER) AS feed_rank
    FROM items i JOIN companies c USING (company_id)""",
)
def feed_union(spark, sf_dir) -> DataFrame:
    """News and documents of every company as one ordered feed."""
    feed = views.company_feed(
        V.companies(spark, sf_dir), V.feed_news(spark, sf_dir),
        V.feed_documents(spark, sf_dir),
    )
    return feed.select(
        "company_id", "ticker", "item_id", "source_type", "title", "category",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"),
        "feed_rank",
    )


@query(
    "feed_filtered",
    f"""WITH {FEED_SQL}, {COMPANIES_SQL}
    SELECT item_id, source_type, title FROM items i JOIN companies c USING (company_id)
    WHERE c.ticker = 'S000042' AND source_type = 'news'""",
)
def feed_filtered(spark, sf_dir) -> DataFrame:
    """The news of one company."""
    return views.company_feed(
        V.companies(spark, sf_dir), V.feed_news(spark, sf_dir),
        V.feed_documents(spark, sf_dir), " s000042", "news",
    ).select("item_id", "source_type", "title")


@query(
    "feed_counts",
    f"""WITH {FEED_SQL}, {COMPANIES_SQL}, t AS (SELECT company_id, unnest({_sql_list(M.SOURCE_TYPES)}) AS source_type FROM companies)
    SELECT t.company_id, t.source_type, count(i.item_id) AS n_items FROM t LEFT JOIN items i
      ON i.company_id = t.company_id AND i.source_type = t.source_type GROUP BY 1, 2""",
)
def feed_counts(spark, sf_dir) -> DataFrame:
    """Items per company and type, zero-filled."""
    items = views.feed_items(
        views.latest_news(V.feed_news(spark, sf_dir)),
        views.latest_documents(V.feed_documents(spark, sf_dir)),
    )
    return views.feed_counts(V.companies(spark, sf_dir), items)


@query(
    "feed_latest",
    """SELECT company_id, item_id FROM (SELECT CAST(user_id AS VARCHAR) AS company_id, CAST(event_id AS VARCHAR) AS item_id,
      row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST,
        CAST(event_id AS VARCHAR)) AS rn FROM events) WHERE rn <= 20""",
)
def feed_latest(spark, sf_dir) -> DataFrame:
    """Latest twenty news per company, undated ones last."""
    return views.latest_news(V.feed_news(spark, sf_dir), 20).select(
        "company_id", F.col("news_id").alias("item_id")
    )


@query(
    "affected_sections",
    f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {_sql_list(v)})" for k, v in M.SOURCE_SECTIONS.items())}) t(source_type, s)),
    i AS (SELECT o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'annual_report' WHEN '2-HIGH' THEN 'concall'
      WHEN '4-NOT SPECIFIED' THEN 'credit_rating' ELSE 'news' END AS source_type FROM orders),
    x AS (SELECT company_id, unnest(s) AS report_section FROM i JOIN m USING (source_type))
    SELECT company_id, report_section, count(*) AS n_items FROM x GROUP BY 1, 2""",
)
def affected_sections(spark, sf_dir) -> DataFrame:
    """Report sections touched by each company's items."""
    pri = F.col("o_orderpriority")
    items = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.when(pri == "1-URGENT", "annual_report").when(pri == "2-HIGH", "concall")
        .when(pri == "4-NOT SPECIFIED", "credit_rating").otherwise("news")
        .alias("source_type"),
    )
    return report.affected_sections(items).groupBy(
        "company_id", "report_section"
    ).agg(F.count("*").alias("n_items"))


# ----------------------------------------------------------------------- queue


@query(
    "queue_counts",
    f"""WITH {V.QUEUE_SQL} SELECT retrieval_status, count(*) AS n_filings FROM queue GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM queue""",
)
def queue_counts(spark, sf_dir) -> DataFrame:
    """Queue rows per status and in total."""
    return views.queue_counts(V.queue(spark, sf_dir))


@query(
    "queue_latest",
    f"""WITH {V.QUEUE_SQL} SELECT company_id, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id
      ORDER BY discovered_at DESC NULLS LAST, filing_id) AS rn FROM queue) WHERE rn <= 50""",
)
def queue_latest(spark, sf_dir) -> DataFrame:
    """Newest fifty queue rows per company."""
    return views.queue_latest(V.queue(spark, sf_dir)).select(
        "company_id", "filing_id"
    )


@query(
    "work_queue",
    f"""WITH {V.QUEUE_SQL} SELECT filing_id, retrieval_status, processing_status FROM queue
    WHERE retrieval_status IN ('pending', 'blocked') OR processing_status IN ('unprocessed', 'queued')""",
)
def work_queue(spark, sf_dir) -> DataFrame:
    """Queue rows with work left."""
    return views.work_queue(V.queue(spark, sf_dir)).select(
        "filing_id", "retrieval_status", "processing_status"
    )


@query(
    "first_filings",
    f"""WITH {V.QUEUE_SQL} SELECT company_id, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id
      ORDER BY filing_id) AS rn FROM queue) WHERE rn <= 10""",
)
def first_filings(spark, sf_dir) -> DataFrame:
    """First ten filings per company in discovery order."""
    rows = V.queue(spark, sf_dir).withColumn("arrival", F.col("filing_id"))
    return views.first_filings(rows).select("company_id", "filing_id")


@query(
    "pipeline_report",
    """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'discovery'
        WHEN '2-HIGH' THEN 'filing' WHEN '3-MEDIUM' THEN 'retrieval' ELSE 'extraction' END AS stage,
        o_orderstatus = 'F' AS ok, o_orderstatus = 'O' AS blocked,
        CASE WHEN o_orderpriority = '5-LOW' THEN month(o_orderdate) - 11 END AS n FROM orders),
      a AS (SELECT company_id, count(*) FILTER (stage = 'discovery') AS sources_attempted,
        count(*) FILTER (stage = 'discovery' AND ok) AS sources_succeeded,
        count(*) FILTER (stage = 'filing') AS filings_discovered,
        count(*) FILTER (stage = 'retrieval' AND ok) AS retrieved,
        count(*) FILTER (stage = 'retrieval' AND NOT ok) AS retrieval_failed,
        count(*) FILTER (stage = 'retrieval' AND NOT ok AND blocked) AS retrieval_blocked,
        count(*) FILTER (stage = 'extraction' AND ok) AS extracted,
        CAST(coalesce(sum(greatest(n, 0)), 0) AS BIGINT) AS metrics_stored,
        bool_and(NOT ok) FILTER (stage = 'discovery') AS all_sources_failed FROM s GROUP BY 1)
    SELECT *, CASE WHEN metrics_stored > 0 THEN 'data_stored' WHEN retrieved > 0 THEN 'retrieved_no_metrics'
      WHEN filings_discovered > 0 THEN 'discovered_not_retrieved' ELSE 'discovery_failed' END AS status FROM a""",
)
def pipeline_report(spark, sf_dir) -> DataFrame:
    """Stage counters and the status ladder per company."""
    pri, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    stages = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"),
        F.when(pri == "1-URGENT", "discovery").when(pri == "2-HIGH", "filing")
        .when(pri == "3-MEDIUM", "retrieval").otherwise("extraction")
        .alias("stage"),
        (status == "F").alias("ok"), (status == "O").alias("blocked"),
        F.when(
            pri == "5-LOW", F.greatest(F.month("o_orderdate") - 11, F.lit(0))
        ).cast("bigint").alias("n_metrics"),
        F.lit(0).cast("bigint").alias("n_conflicts"),
    )
    return views.pipeline_report(stages).drop("conflicts")


@query(
    "persist_report",
    f"""WITH {COMPANIES_SQL}, o AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id,
        CASE WHEN o_orderstatus = 'O' THEN 'news' ELSE 'filing' END AS source_type, o_orderkey AS arrival,
        o_orderpriority <> '2-HIGH' AS kept,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'error ' || o_orderkey END AS error FROM orders),
      g AS (SELECT company_id, source_type, count(*) AS fetched, count(*) FILTER (kept AND error IS NULL) AS stored,
        count(*) FILTER (NOT kept AND error IS NULL) AS skipped, arg_min(error, arrival) FILTER (error IS NOT NULL) AS first_error
        FROM o GROUP BY 1, 2),
      t AS (SELECT company_id, unnest({_sql_list(M.SOURCE_TYPES)}) AS source_type FROM companies)
    SELECT company_id, source_type, coalesce(fetched, 0) AS fetched, coalesce(stored, 0) AS stored,
      coalesce(skipped, 0) AS skipped, first_error FROM t LEFT JOIN g USING (company_id, source_type)""",
)
def persist_report(spark, sf_dir) -> DataFrame:
    """Fetched, stored, skipped and first error per source type."""
    pri = F.col("o_orderpriority")
    outcomes = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"),
        F.when(F.col("o_orderstatus") == "O", "news").otherwise("filing")
        .alias("source_type"),
        F.col("o_orderkey").alias("arrival"),
        (pri != "2-HIGH").alias("kept"),
        F.when(
            pri == "5-LOW",
            F.concat(F.lit("error "), F.col("o_orderkey").cast("string")),
        ).alias("error"),
    )
    return views.persist_report(V.companies(spark, sf_dir), outcomes)


# --------------------------------------------------------------- stored tables


@query(
    "sparse_patch",
    f"""WITH {V.QUEUE_SQL} SELECT q.filing_id, CASE WHEN q.value > 20 THEN 'patched' ELSE q.retrieval_status END AS retrieval_status,
      CASE WHEN q.value > 40 THEN NULL ELSE q.k END AS k FROM queue q""",
)
def sparse_patch(spark, sf_dir) -> DataFrame:
    """Patch queue rows; an explicit NULL overwrites, an absent field stays."""
    queue = V.queue(spark, sf_dir)
    none = F.lit(None).cast("string")
    patch = F.when(
        F.col("value") > 40,
        F.create_map(F.lit("retrieval_status"), F.lit("patched"), F.lit("k"), none),
    ).otherwise(F.create_map(F.lit("retrieval_status"), F.lit("patched")))
    patches = queue.where("value > 20").select(
        "filing_id", patch.alias("patch")
    )
    return tables.sparse_patch(
        queue.select("filing_id", "retrieval_status", "k"), patches,
        "filing_id", ["retrieval_status", "k"],
    )


@query(
    "upsert",
    """WITH t AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS note FROM customer),
      s AS (SELECT o_custkey + 100 AS id, 'new ' || max(o_orderkey) AS name,
        CASE WHEN count(*) > 10 THEN 'note ' || count(*) END AS note FROM orders GROUP BY 1)
    SELECT id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE t.name END AS name, coalesce(s.note, t.note) AS note
    FROM t FULL OUTER JOIN s USING (id)""",
)
def upsert(spark, sf_dir) -> DataFrame:
    """Insert new keys, update known ones, keep a note the source lacks."""
    target = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("note"),
    )
    source = V.table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") + 100).alias("id")
    ).agg(
        F.concat(F.lit("new "), F.max("o_orderkey").cast("string")).alias("name"),
        F.when(
            F.count("*") > 10,
            F.concat(F.lit("note "), F.count("*").cast("string")),
        ).alias("note"),
    )
    return tables.upsert(target, source, ["id"], ["note"])


@query(
    "add_missing",
    f"""WITH {COMPANIES_SQL} SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker, c_name AS name,
      'BSE' AS exchange, 'Unclassified' AS sector, 'Unclassified' AS industry,
      c_name || ' — added automatically.' AS short_description, true AS is_active
    FROM customer WHERE 'S' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') NOT IN (SELECT ticker FROM companies)""",
)
def add_missing(spark, sf_dir) -> DataFrame:
    """Companies to insert: tickers not stored yet."""
    new = V.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" s"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
        .alias("ticker"),
        F.col("c_name").alias("name"),
    )
    return tables.add_missing_companies(V.companies(spark, sf_dir), new)


@query(
    "row_checks",
    """SELECT o_orderkey AS row_id, concat_ws(',',
      CASE WHEN CAST(left(o_orderpriority, 1) AS INTEGER) > 4 THEN 'tier' END,
      CASE WHEN o_totalprice > 300000 THEN 'price' END,
      CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END) AS violations FROM orders""",
)
def row_checks(spark, sf_dir) -> DataFrame:
    """Failed table checks of each row."""
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = V.table(spark, sf_dir, "orders").withColumn("source_tier", tier)
    checks = {
        "tier": views.table_checks("financial_metrics")["tier"],
        "price": F.col("o_totalprice") <= 300000,
        "status": F.col("o_orderstatus").isin("F", "O"),
    }
    return views.row_checks(rows, checks).select(
        F.col("o_orderkey").alias("row_id"),
        F.array_join("violations", ",").alias("violations"),
    )


@query(
    "preflight",
    """SELECT doc_id, concat_ws(',', CASE WHEN lang <> 'en' THEN 'lang' END,
      CASE WHEN source <> 'src1' THEN 'source' END) AS violations FROM documents""",
)
def preflight(spark, sf_dir) -> DataFrame:
    """Document columns that differ from the wanted values."""
    rows = V.table(spark, sf_dir, "documents")
    return views.document_preflight(
        rows, {"lang": "en", "source": "src1"}
    ).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query(
    "source_lineage",
    f"""WITH reg(source_name, tier) AS (VALUES {", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {t})" for n, k, t in M.SOURCE_REGISTRY)}),
    e AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Company Annual Report'
      WHEN '2-HIGH' THEN 'Earnings Call Transcript' WHEN '3-MEDIUM' THEN 'Financial News Provider'
      ELSE 'Unlisted' END AS source_name, CAST(year(o_orderdate) AS VARCHAR) AS p, o_orderstatus AS b FROM orders)
    SELECT c_custkey AS conclusion_id, CAST(o_orderkey AS VARCHAR) AS evidence_id, source_name, CAST(tier AS INTEGER) AS tier,
      b AS accounting_basis, p AS reporting_period
    FROM customer LEFT JOIN e ON o_custkey = c_custkey LEFT JOIN reg USING (source_name)""",
)
def source_lineage(spark, sf_dir) -> DataFrame:
    """Conclusion -> evidence -> metric -> source registry."""
    orders = V.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    pri = F.col("o_orderpriority")
    conclusions = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("conclusion_id"),
        F.col("c_name").alias("conclusion"),
    )
    evidence = orders.select(
        F.col("o_custkey").alias("conclusion_id"), key.alias("evidence_id"),
        key.alias("metric_id"),
    )
    metrics = orders.select(
        key.alias("metric_id"),
        F.when(pri == "1-URGENT", "Company Annual Report")
        .when(pri == "2-HIGH", "Earnings Call Transcript")
        .when(pri == "3-MEDIUM", "Financial News Provider")
        .otherwise("Unlisted").alias("source_name"),
        F.col("o_orderstatus").alias("accounting_basis"),
        F.year("o_orderdate").cast("string").alias("reporting_period"),
    )
    return report.lineage(
        conclusions, evidence, metrics, tables.source_registry(spark)
    ).select(
        "conclusion_id", "evidence_id", "source_name", "tier",
        "accounting_basis", "reporting_period",
    )


@query(
    "unknown_rules",
    f"""WITH r(framework, rule_key) AS (VALUES {", ".join(f"('{f}', '{r}')" for f, r, a, b in R.CROSS_CHECK_RULES)})
    SELECT p_partkey AS row_id, CASE p_type WHEN 'SMALL' THEN 'bank' ELSE 'epc' END AS framework,
      'profit_vs_cashflow' AS rule_key FROM part
    WHERE (CASE p_type WHEN 'SMALL' THEN 'bank' ELSE 'epc' END, 'profit_vs_cashflow') NOT IN (SELECT framework, rule_key FROM r)""",
)
def unknown_rules(spark, sf_dir) -> DataFrame:
    """Stored rule keys the catalogue does not know."""
    stored = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(F.col("p_type") == "SMALL", "bank").otherwise("epc")
        .alias("framework"),
        F.lit("profit_vs_cashflow").alias("rule_key"),
    )
    rules = fixed_table(
        spark, ["framework", "rule_key", "metric_a", "metric_b"],
        R.CROSS_CHECK_RULES,
    )
    return facts.unknown_rules(stored, rules)
