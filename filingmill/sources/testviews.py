"""The driver's test tables in the shapes of this domain.

Suppliers stand for companies, orders for filings, order revenue for incoming
metrics, documents for paged reports, order events for the filing queue. Every
view reads its whole tables; values are derived from the rows themselves.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "string"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt by key, for views that make a payload of each order.

    Landed payloads lie in many files; the orders may lie in one. Whatever the
    size, they are dealt once, before the payloads exist.
    """
    return table(spark, sf_dir, "orders").repartition("o_orderkey")


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(TEXT)


# ------------------------------------------------------------------- companies


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation and region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _s("s_suppkey").alias("company_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("S"), F.lpad(_s("s_suppkey"), 6, "0"))
            .alias("ticker"),
            F.col("r_name").alias("exchange"),
            F.concat_ws(" / ", "n_name", "r_name").alias("short_description"),
            (F.col("s_acctbal") > 0).alias("is_active"),
            _s("n_nationkey").alias("parent_company_id"),
        )
    )


# --------------------------------------------------------------------- metrics


def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per order and line status, in whole 1/10,000 units.

    Lines are reduced to one row per order and status before the join with
    orders, so the join moves a quarter of the rows.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    keep = 100 - F.round(F.col("l_discount") * 100).cast("bigint")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linestatus")
        .agg(
            F.sum(cents * keep).alias("units"),
            F.sum(
                F.when(F.col("l_returnflag") == "R", 0)
                .otherwise(cents * keep)
            ).alias("kept_units"),
        )
    )
    return table(spark, sf_dir, "orders").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey")
    ).withColumn("fiscal_year", F.year("o_orderdate").cast("bigint")).withColumn(
        "accounting_basis",
        F.when(F.col("l_linestatus") == "F", "CONSOLIDATED")
        .otherwise("STANDALONE"),
    )


def _with_nation(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    return (
        rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def yearly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, profit proxy and receivables per nation, year and basis.

    Orders are reduced per customer before the customer join.
    """
    per_customer = (
        order_revenue(spark, sf_dir)
        .groupBy("o_custkey", "fiscal_year", "accounting_basis")
        .agg(
            F.sum("units").alias("units"),
            F.sum("kept_units").alias("kept_units"),
            F.sum(
                F.when(F.col("o_orderstatus") == "O", F.col("units"))
                .otherwise(0)
            ).alias("open_units"),
        )
    )
    scale = F.lit(10000.0)
    return (
        _with_nation(spark, sf_dir, per_customer)
        .groupBy(
            F.col("n_name").alias("entity_name"), "fiscal_year",
            "accounting_basis",
        )
        .agg(
            (F.sum("units").cast("double") / scale).alias("revenue"),
            (F.sum("kept_units").cast("double") / scale).alias("pat"),
            (F.sum("open_units").cast("double") / scale).alias("receivables"),
        )
    )


def incoming_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incoming metric per order and basis, with rejects among them."""
    rows = _with_nation(spark, sf_dir, order_revenue(spark, sf_dir))
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    return rows.select(
        F.col("o_orderkey").alias("arrival"),
        _s("n_nationkey").alias("company_id"),
        F.col("n_name").alias("entity_name"),
        F.when(F.col("o_orderstatus") == "F", "revenue")
        .when(F.col("o_orderstatus") == "O", "receivables")
        .otherwise("order_intake").alias("metric_name"),
        F.floor(F.col("units") / F.lit(1e9)).cast("double")
        .alias("metric_value"),
        F.when(F.col("n_regionkey") == 2, "INR").otherwise("USD")
        .alias("currency"),
        F.concat(F.lit("FY"), F.right(_s("fiscal_year"), F.lit(2)))
        .alias("reporting_period"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("accounting_basis"))
        .alias("accounting_basis"),
        F.col("o_orderpriority").alias("source_name"),
        F.least(tier, F.lit(4)).alias("source_tier"),
    )


INCOMING_SQL = """
incoming AS (
  SELECT o_orderkey AS arrival, CAST(n_nationkey AS VARCHAR) AS company_id,
         n_name AS entity_name,
         CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'receivables'
              ELSE 'order_intake' END AS metric_name,
         CAST(floor(units / 1e9) AS DOUBLE) AS metric_value,
         CASE WHEN n_regionkey = 2 THEN 'INR' ELSE 'USD' END AS currency,
         'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS reporting_period,
         CASE WHEN o_orderpriority <> '5-LOW' THEN
           CASE WHEN l_linestatus = 'F' THEN 'CONSOLIDATED' ELSE 'STANDALONE' END
         END AS accounting_basis,
         o_orderpriority AS source_name,
         least(CAST(left(o_orderpriority, 1) AS INTEGER), 4) AS source_tier
  FROM (SELECT l_orderkey, l_linestatus,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
                   * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) AS units
        FROM lineitem GROUP BY 1, 2)
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
)"""

YEARLY_SQL = """
yearly AS (
  SELECT n_name AS entity_name, year(o_orderdate) AS fiscal_year,
         CASE WHEN l_linestatus = 'F' THEN 'CONSOLIDATED' ELSE 'STANDALONE' END AS accounting_basis,
         CAST(sum(u) AS DOUBLE) / 10000 AS revenue,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE u END) AS DOUBLE) / 10000 AS pat,
         CAST(sum(CASE WHEN o_orderstatus = 'O' THEN u ELSE 0 END) AS DOUBLE) / 10000 AS receivables
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT)
                  * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS u FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  GROUP BY 1, 2, 3
)"""


# ------------------------------------------------------------------- headlines

# Runs in Spark SQL and in DuckDB alike.
_HEADLINES = """
  SELECT o_orderkey AS item_id, CAST(o_custkey AS STRING) AS company_id,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN 'Board approves dividend of ₹'
        || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' crore'
      WHEN '2-HIGH' THEN 'Financial results Q' || CAST(quarter(o_orderdate) AS STRING)
        || ' FY' || CAST(year(o_orderdate) AS STRING)
      WHEN '3-MEDIUM' THEN 'Earnings Call Transcript FY' || CAST(year(o_orderdate) AS STRING)
        || '-' || right(CAST(year(o_orderdate) + 1 AS STRING), 2)
      WHEN '4-NOT SPECIFIED' THEN 'Credit rating of ' || CAST(o_custkey AS STRING)
        || ' million loan reaffirmed, plant  expansion'
      ELSE 'General   meeting notice ' || CAST(month(o_orderdate) AS STRING)
    END AS title,
    CASE o_orderstatus WHEN 'F' THEN 'Board Meeting'
      WHEN 'O' THEN 'Company Update' ELSE 'Credit Rating' END AS category,
    'http://feed.example.com/' || CAST(o_custkey AS STRING) || '/'
      || CAST(year(o_orderdate) AS STRING) AS url,
    CASE o_orderstatus WHEN 'F' THEN 'Shares rise on outlook and order wins'
      WHEN 'O' THEN 'Regulator asks for details' ELSE '' END AS summary,
    o_orderdate AS published_at
  FROM {orders}"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One announcement or news headline per order."""
    return spark.sql(_HEADLINES, orders=keyed_orders(spark, sf_dir))


HEADLINES_SQL = "headlines AS (" + _HEADLINES.format(orders="orders") + ")"


# ------------------------------------------------------------------- documents


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored reports: lines are pages, languages are companies."""
    text = F.col("text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "documents").select(
        _s("doc_id").alias("document_id"),
        F.col("lang").alias("company_id"),
        text.alias("content"),
        breaks.cast("int").alias("page_count"),
        F.split(text, "\n")[0].alias("title"),
        F.col("source").alias("source_name"),
    )


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a chunk, its sentences are the chunk's lines."""
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("lang").alias("company_id"),
            _s("doc_id").alias("document_id"),
            F.posexplode(F.split("text", "\n")).alias("pos", "line"),
        )
        .select(
            "company_id", "document_id",
            (F.col("pos") + 1).alias("chunk_index"),
            (F.col("pos") + 1).alias("page_start"),
            (F.col("pos") + 1).alias("page_end"),
            F.replace(F.col("line"), F.lit(". "), F.lit(".\n"))
            .alias("content"),
        )
    )


CHUNKS_SQL = """
chunks AS (
  SELECT lang AS company_id, CAST(doc_id AS VARCHAR) AS document_id, chunk_index,
         replace(lines[chunk_index], '. ', '.' || chr(10)) AS content
  FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS lines,
               unnest(generate_series(1, len(string_split(text, chr(10))))) AS chunk_index
        FROM documents)
)"""

# Retrieval queries in the words of the test prose.
TEST_QUERIES = {
    "english": ["that with the", "was", "from are", "thing"],
    "french": ["que le", "dans pour", "une"],
    "german": ["der und", "nicht ein", "keit"],
    "mixed": ["token", "copyright license"],
}

_COMMON = (
    "that with the was from are thing que le dans pour une der und nicht ein".split()
)
# As many queries as the catalogue has: ordered pairs of common words.
MANY_QUERIES: dict[str, list[str]] = {}
for _a, _b in itertools.islice(itertools.permutations(_COMMON, 2), 163):
    MANY_QUERIES.setdefault(_a, []).append(f"{_a} {_b}")


def feed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as news rows of a company per user."""
    return table(spark, sf_dir, "events").select(
        _s("event_id").alias("news_id"),
        _s("user_id").alias("company_id"),
        F.concat_ws(" ", "event_type", F.col("props")).alias("headline"),
        F.lit(None).cast(TEXT).alias("summary"),
        F.when(F.col("event_type") != "error", F.col("ts"))
        .alias("published_at"),
        F.col("event_type").alias("source_name"),
        F.col("props").alias("source_url"),
        F.col("event_type").alias("category"),
        F.col("value").alias("relevance_score"),
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored documents of a company per customer."""
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Annual_Report")
        .when(F.col("o_orderpriority") == "2-HIGH", "concall")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "unknown")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "credit_rating")
    )
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        _s("o_orderkey").alias("document_id"),
        _s("o_custkey").alias("company_id"),
        F.concat(F.lit("Order "), _s("o_orderkey")).alias("title"),
        kind.alias("document_type"),
        F.when(F.col("o_orderstatus") == "F", day).alias("publication_date"),
        F.when(F.col("o_orderstatus") == "O", day).alias("document_date"),
        F.col("o_orderpriority").alias("source_name"),
        F.lit(None).cast(TEXT).alias("source_url"),
        F.lit(None).cast(TEXT).alias("document_url"),
        F.lit(None).cast(TEXT).alias("reporting_period"),
        F.lit(None).cast(TEXT).alias("processing_status"),
        F.col("o_orderstatus").alias("text_extraction_status"),
        F.col("o_orderdate").alias("created_at"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as filing-queue rows."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("filing_id"),
        _s("user_id").alias("company_id"),
        F.when(kind == "click", "pending").when(kind == "error", "failed")
        .when(kind == "view", "blocked").otherwise("complete")
        .alias("retrieval_status"),
        F.when(kind == "signup", "queued").otherwise("processed")
        .alias("processing_status"),
        F.col("ts").alias("discovered_at"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


QUEUE_SQL = """
queue AS (
  SELECT event_id AS filing_id, CAST(user_id AS VARCHAR) AS company_id,
         CASE event_type WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed'
              WHEN 'view' THEN 'blocked' ELSE 'complete' END AS retrieval_status,
         CASE event_type WHEN 'signup' THEN 'queued' ELSE 'processed' END AS processing_status,
         ts AS discovered_at, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def discovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as discovered items, one feed per customer."""
    kind = F.when(F.col("category") == "Company Update", "news").otherwise(
        "filing"
    )
    none = F.lit(None).cast(TEXT)
    return headlines(spark, sf_dir).select(
        F.col("item_id").alias("arrival"), "company_id",
        kind.alias("source_type"), "title", none.alias("headline"),
        "summary", F.col("published_at").alias("publication_date"),
        none.alias("publisher"), F.col("url").alias("original_url"),
        none.alias("document_url"), none.alias("quarter"),
        none.alias("financial_year"), none.alias("content_hash"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


# -------------------------------------------------------------------- findings

_CLAIMS = """
  SELECT CAST(o_custkey AS STRING) AS company_id,
    CAST(year(o_orderdate) AS STRING) AS document_id,
    o_orderkey AS finding_pos, CAST(o_orderkey AS STRING) AS finding_id,
    o_orderpriority AS specialist, o_orderstatus AS report_section,
    'Orders of client ' || CAST(o_custkey AS STRING) || ' grew to ₹'
      || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' crore in FY'
      || CAST(year(o_orderdate) AS STRING) AS fact,
    CASE o_orderstatus
      WHEN 'F' THEN 'Client ' || CAST(o_custkey AS STRING) || ' orders grew to '
        || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' crore'
      WHEN 'O' THEN 'Orders grew to '
        || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' crore this year'
      ELSE '' END AS supporting_quote,
    o_orderpriority = '5-LOW' AS uncited,
    o_orderpriority = '4-NOT SPECIFIED' AS thin,
    o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' AS insufficient_evidence,
    o_totalprice AS result, month(o_orderdate) AS m
  FROM {orders}"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim with a quote per order."""
    return spark.sql(_CLAIMS, orders=keyed_orders(spark, sf_dir))


CLAIMS_SQL = "claims AS (" + _CLAIMS.format(orders="orders") + ")"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in the finding schema, one calculation each."""
    cite = F.struct(
        F.col("m").cast("int").alias("chunk_index"),
        F.col("m").cast("int").alias("page_start"),
        (F.col("m") + F.when(F.col("m") > 6, 1).otherwise(0)).cast("int")
        .alias("page_end"),
        F.concat(F.lit("Chunk "), _s("m")).alias("chunk_label"),
    )
    second = F.when(F.col("m") == 1, "STANDALONE").otherwise("CONSOLIDATED")
    inputs = F.array(
        *[
            F.struct(
                F.lit("amount").alias("label"), F.col("result").alias("value"),
                F.lit("cr").alias("unit"), F.lit("FY").alias("period"),
                b.alias("basis"),
            )
            for b in (F.lit("CONSOLIDATED"), second)
        ]
    )
    calculation = F.struct(
        F.lit("Order Value").alias("metric"), inputs.alias("inputs"),
        F.lit("a").alias("formula"), F.col("result").alias("result"),
        F.lit("x").alias("result_label"), F.lit("FY").alias("period"),
    )
    none = F.array().cast(
        "array<struct<chunk_index:int,page_start:int,page_end:int,"
        "chunk_label:string>>"
    )
    return claims(spark, sf_dir).select(
        "company_id", "document_id", "finding_pos", "finding_id",
        "specialist", "report_section",
        F.lit("q").alias("research_question"), "fact",
        F.array().cast("array<string>").alias("data_points"),
        F.array(calculation).alias("calculations"),
        F.when(F.col("thin"), "short")
        .otherwise("The order book moved because of larger single orders.")
        .alias("analysis"),
        F.when(F.col("thin"), "").otherwise("Watch the next order intake.")
        .alias("investor_implication"),
        F.lit("FACT").alias("classification"),
        F.lit("HIGH").alias("confidence"),
        F.lit("CONSOLIDATED").alias("accounting_basis"),
        F.lit("FY").alias("period"),
        F.when(F.col("uncited"), none).otherwise(F.array(cite))
        .alias("citations"),
        "supporting_quote", "insufficient_evidence",
        F.lit(None).cast(TEXT).alias("insufficient_reason"),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before them as their quote."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"),
        F.col("text").alias("quote"),
    )
    return turns.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("claim"), "quote"
    )


TURNS_SQL = """
turns AS (
  SELECT a.conv_id, a.turn, a.text AS claim, b.text AS quote
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn + 1 = a.turn
  WHERE a.role = 'assistant'
)"""
