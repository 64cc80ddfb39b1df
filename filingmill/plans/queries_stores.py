"""Queries on sinks, catalogues and the smaller column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.operators import conclusions as K
from filingmill.operators import facts, qa, report
from filingmill.plans.catalog import query
from filingmill.rules import research as R
from filingmill.session import shared_folder
from filingmill.sources import tables
from filingmill.sources import testviews as V


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _pairs(table: dict) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, listed in table.items() for v in listed)
    return f"(VALUES {rows})"


# ----------------------------------------------------------------------- sinks

_STORED = """SELECT left(sha256(lang || '::' || source || '::' || string_split(text, chr(10))[1]), 32) AS document_id,
  lang AS company_id, length(text) AS n_chars, sha256(text) AS content_sha256 FROM documents"""


@query("appended_documents", f"{_STORED} UNION ALL {_STORED} WHERE source = 'src0'")
def appended_documents(spark, sf_dir) -> DataFrame:
    """Whole documents with repeatable ids, appended in two writes."""
    path = _folder(spark)
    rows = V.documents(spark, sf_dir).select(
        "company_id", "content", "title",
        F.lit(None).cast("string").alias("document_url"),
        F.col("source_name").alias("source_url"),
    )
    stored = tables.stored_documents(rows)
    tables.append(stored, path, ["company_id"])
    tables.append(stored.where("source_url = 'src0'"), path, ["company_id"])
    return spark.read.parquet(path).select(
        "document_id", "company_id",
        F.length("content").cast("long").alias("n_chars"),
        F.sha2("content", 256).alias("content_sha256"),
    )


@query(
    "replaced_scope",
    """SELECT o_orderkey, o_orderpriority AS scope, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'new' ELSE 'old' END AS state
    FROM orders WHERE NOT (left(o_orderpriority, 1) IN ('1', '2') AND o_orderstatus <> 'F') AND o_orderpriority <> '5-LOW'""",
)
def replaced_scope(spark, sf_dir) -> DataFrame:
    """Orders by scope: two scopes replaced, one of the listed scopes emptied."""
    path = _folder(spark)
    rows = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("scope"),
        F.lit("old").alias("state"),
    )
    tables.replace_scope(rows, path, ["scope"])
    fresh = rows.where("left(scope, 1) IN ('1', '2') AND o_orderstatus = 'F'")
    tables.replace_scope_checked(
        spark, fresh.withColumn("state", F.lit("new")), path, ["scope"],
        _folder(spark), rows.where("left(scope, 1) IN ('1', '2', '5')"),
    )
    return spark.read.parquet(path).select("o_orderkey", "scope", "state")


@query(
    "replaced_chunks",
    f"""WITH {V.CHUNKS_SQL} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(content) AS content_sha256
    FROM chunks WHERE CASE CAST(document_id AS BIGINT) % 4 WHEN 0 THEN chunk_index <= 2 WHEN 1 THEN false ELSE true END""",
)
def replaced_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of all documents; some get fewer, some lose all of theirs."""
    path = _folder(spark)
    chunks = V.paragraph_chunks(spark, sf_dir)
    tables.write_chunks(chunks, path, buckets=16)
    rest = F.pmod(F.col("document_id").cast("long"), F.lit(4))
    tables.write_chunks(
        chunks.where((rest == 0) & (F.col("chunk_index") <= 2)), path, buckets=16,
        documents=V.documents(spark, sf_dir).where(rest <= 1).select("document_id"),
    )
    return spark.read.parquet(path).select(
        "document_id", F.col("chunk_index").cast("int").alias("chunk_index"),
        F.sha2("content", 256).alias("content_sha256"),
    )


@query(
    "array_columns",
    """SELECT c_custkey, CASE WHEN c_custkey IN (2, 3) THEN (SELECT c_name FROM customer WHERE c_custkey = 1) ELSE c_name END
      || '/' || CASE WHEN c_custkey IN (2, 3) THEN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1) ELSE c_mktsegment END AS tags
    FROM customer""",
)
def array_columns(spark, sf_dir) -> DataFrame:
    """Arrays with an appended element, then one row's array on two others."""
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.array("c_name").alias("tags"))
    longer = tables.append_to_array(rows, "tags", F.array("c_mktsegment"))
    out = tables.copy_array_from(longer, "c_custkey", 1, [2, 3], "tags")
    return out.select("c_custkey", F.array_join("tags", "/").alias("tags"))


# ------------------------------------------------------------------ catalogues

_SECTIONS = list(R.SECTION_CHECK_CATEGORIES)
_CATEGORIES = sorted({c for listed in R.SECTION_CHECK_CATEGORIES.values() for c in listed})


@query(
    "section_checks",
    f"""SELECT o.o_orderkey, s.section_key, t.category, p.p_partkey FROM orders o
    JOIN (SELECT *, row_number() OVER () - 1 AS n FROM (SELECT unnest({_SECTIONS}) AS section_key)) s ON s.n = o.o_custkey % {len(_SECTIONS)}
    JOIN {_pairs(R.SECTION_CHECK_CATEGORIES)} t(section_key, category) ON t.section_key = s.section_key
    JOIN part p ON ({_CATEGORIES})[1 + p.p_partkey % {len(_CATEGORIES)}] = t.category
      AND p.p_size = 1 + o.o_orderkey % 50 AND p.p_brand = 'Brand#' || CAST(1 + o.o_custkey % 25 AS VARCHAR)""",
)
def section_checks(spark, sf_dir) -> DataFrame:
    """Research checks of each section through its categories, brand and size."""
    names = F.array(*[F.lit(s) for s in _SECTIONS])
    kinds = F.array(*[F.lit(c) for c in _CATEGORIES])
    sections = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(names, (F.col("o_custkey") % len(_SECTIONS)).cast("int")).alias("section_key"),
        (1 + F.col("o_orderkey") % 50).cast("int").alias("p_size"),
        F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("p_brand"),
    )
    checks = V.table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_brand", F.get(kinds, (F.col("p_partkey") % len(_CATEGORIES)).cast("int")).alias("category")
    )
    return report.section_checks(sections, checks, ["p_size", "p_brand"]).select(
        "o_orderkey", "section_key", "category", "p_partkey"
    )


def _frameworks(spark, sf_dir) -> DataFrame:
    """One framework per customer; its orders are sections and checks."""
    section = F.struct(
        F.col("o_orderkey").cast("string").alias("section_key"),
        F.col("o_clerk_no").cast("string").alias("section_label"),
        F.lit("text").alias("description"),
        (F.col("o_orderstatus") == "F").alias("required"),
    )
    check = F.struct(
        F.col("o_orderkey").cast("string").alias("check_key"),
        F.col("o_orderpriority").alias("category"),
    )
    orders = V.table(spark, sf_dir, "orders").withColumn("o_clerk_no", F.col("o_orderkey") % 7)
    return orders.groupBy(F.col("o_custkey").cast("string").alias("industry_type")).agg(
        F.collect_list(section).alias("analysis_sections"),
        F.collect_list(check).alias("research_checks"),
    )


@query(
    "framework_filters",
    """SELECT CAST(o_custkey AS VARCHAR) AS industry_type, 'section' AS kind, CAST(o_orderkey AS VARCHAR) AS item
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'check', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def framework_filters(spark, sf_dir) -> DataFrame:
    """Required sections and the checks of one category."""
    frameworks = _frameworks(spark, sf_dir)
    needed = report.required_sections(frameworks).select(
        "industry_type", F.lit("section").alias("kind"), F.col("section_key").alias("item")
    )
    found = report.checks_in_category(frameworks, "2-HIGH").select(
        "industry_type", F.lit("check").alias("kind"), F.col("check_key").alias("item")
    )
    return needed.unionByName(found)


# --------------------------------------------------------------------- columns


@query(
    "indian_digits",
    """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * power(10, o_orderkey % 5) AS x FROM orders),
    n AS (SELECT o_orderkey, CAST(x AS BIGINT) AS n FROM t)
    SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR)
      WHEN n < 100000 THEN (n // 1000) || printf(',%03d', n % 1000)
      WHEN n < 10000000 THEN (n // 100000) || printf(',%02d,%03d', n // 1000 % 100, n % 1000)
      WHEN n < 1000000000 THEN (n // 10000000) || printf(',%02d,%02d,%03d', n // 100000 % 100, n // 1000 % 100, n % 1000)
      ELSE (n // 1000000000) || printf(',%02d,%02d,%02d,%03d', n // 10000000 % 100, n // 100000 % 100, n // 1000 % 100, n % 1000)
      END AS grouped FROM n""",
)
def indian_digits(spark, sf_dir) -> DataFrame:
    """Order totals of many sizes in Indian grouping."""
    whole = F.floor("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5).cast("long")
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", T.indian_digits(whole.cast("long")).alias("grouped")
    )


@query(
    "nfkc_text",
    """SELECT doc_id, sha256('fi1 (a) m2 ' || text) AS plain_sha256 FROM documents""",
)
def nfkc_text(spark, sf_dir) -> DataFrame:
    """Whole texts behind a run of compatibility letters, in plain form."""
    odd = F.concat(F.lit("ﬁ① ⒜ m² "), F.col("text"))
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.nfkc(odd), 256).alias("plain_sha256")
    )


@query(
    "kept_calculations",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) <> '1' THEN 1 ELSE 0 END AS n_kept FROM orders""",
)
def kept_calculations(spark, sf_dir) -> DataFrame:
    """Calculations whose inputs stand in the excerpt, on one basis."""
    paid = (F.col("o_custkey") + 500_000).cast("double")

    def given(value, basis):
        return F.struct(
            F.lit("x").alias("label"), value.alias("value"), F.lit("crore").alias("unit"),
            F.lit("FY24").alias("period"), basis.alias("basis"),
        )

    second = F.when(F.col("o_orderpriority").startswith("1"), "STANDALONE").otherwise("NOT_APPLICABLE")
    calculation = F.struct(
        F.lit("growth").alias("metric"),
        F.array(given(paid, F.lit("CONSOLIDATED")), given(paid, second)).alias("inputs"),
        F.lit("a / b").alias("formula"), paid.alias("result"),
        F.lit("1").alias("result_label"), F.lit("FY24").alias("period"),
    )
    shown = F.when(F.col("o_orderstatus") == "F", paid).otherwise(paid + 1)
    excerpt = F.concat(F.lit("Orders rose to "), qa.number_text(shown), F.lit(" crore"))
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.size(qa.kept_calculations(F.array(calculation), excerpt)).alias("n_kept")
    )


@query(
    "conclusion_rows",
    """SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderkey AS VARCHAR) AS document_id,
      CASE WHEN o_orderstatus = 'F' THEN 'summary' ELSE 'financial' END AS report_section,
      CASE WHEN o_orderstatus = 'O' THEN 'INFERENCE' ELSE 'FACT' END AS evidence_type,
      CASE WHEN left(o_orderpriority, 1) = '1' THEN '[CONSOLIDATED] ' || o_orderpriority ELSE o_orderpriority END AS data_point,
      CASE WHEN o_orderstatus = 'O' THEN 'Claim ' || o_orderkey END AS ai_interpretation
    FROM orders""",
)
def conclusion_rows(spark, sf_dir) -> DataFrame:
    """Section and summary conclusions as evidence rows."""
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"),
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", "summary").otherwise("financial").alias("section_key"),
        F.concat(F.lit("Claim "), F.col("o_orderkey").cast("string")).alias("claim"),
        F.when(F.col("o_orderstatus") == "O", "INFERENCE").otherwise("FACT").alias("classification"),
        F.lit("MEDIUM").alias("confidence"),
        F.lit("CONSOLIDATED").alias("accounting_basis"),
        F.col("o_orderpriority").startswith("1").alias("financial_figure"),
        F.col("o_orderpriority").alias("data_point"),
    )
    out = report.conclusion_rows(
        rows.where("section_key = 'financial'"), rows.where("section_key = 'summary'")
    )
    return out.select(
        "company_id", "document_id", "report_section", "evidence_type", "data_point", "ai_interpretation"
    )


@query(
    "extraction_outcome",
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' ELSE 'xbrl' END AS document_type,
      doc_id % 3 = 0 AS ok, CASE doc_id % 3 WHEN 1 THEN 'PARSING_FAILED' WHEN 2 THEN 'XBRL_UNSUPPORTED' END AS reason,
      CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS text_sha256 FROM documents""",
)
def extraction_outcome(spark, sf_dir) -> DataFrame:
    """Route and outcome of whole texts by content type."""
    kind = F.get(
        F.array(F.lit("text/plain"), F.lit("application/pdf"), F.lit("application/xml")),
        (F.col("doc_id") % 3).cast("int"),
    )
    rows = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("company_id"),
        F.col("source").alias("entity_name"),
        F.lit("FY24").alias("reporting_period"), kind.alias("content_type"), F.col("text").alias("payload"),
    )
    return facts.extraction_outcome(rows, facts.extract_facts(rows)).select(
        "document_id", "document_type", "ok", "reason", F.sha2("raw_text", 256).alias("text_sha256")
    )


@query(
    "conclusion_status",
    """WITH s AS (SELECT DISTINCT o_custkey, 1 + o_orderkey % 4 AS sec FROM orders), a AS (
      SELECT o_custkey, 1 + o_orderkey % 4 AS sec, count(*) AS n, count(*) FILTER (o_orderpriority <> '5-LOW') AS good
      FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT CAST(s.o_custkey AS VARCHAR) AS company_id, CAST(s.sec AS VARCHAR) AS section_key, coalesce(n, 0) AS n_conclusions,
      coalesce(good, 0) AS n_supported, CASE WHEN good > 0 THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS status
    FROM s LEFT JOIN a USING (o_custkey, sec)""",
)
def conclusion_status(spark, sf_dir) -> DataFrame:
    """Status of all sections, also of those without accepted conclusions."""
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"), F.lit("d").alias("document_id"),
        (1 + F.col("o_orderkey") % 4).cast("string").alias("section_key"), "o_orderstatus",
        F.when(F.col("o_orderpriority") == "5-LOW", "UNCERTAIN").otherwise("FACT").alias("classification"),
    )
    accepted = rows.where("o_orderstatus = 'F'")
    return K.section_status(accepted, sections=rows).drop("document_id")


# -------------------------------------------------------------------- findings

_FINISHED = f"""{V.TURNS_SQL}, w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(claim), '[^a-z0-9%₹]+', ' ', 'g')), ' '),
    lambda t: length(t) > 3) AS words, trim(regexp_replace(lower(quote), '[^a-z0-9%₹]+', ' ', 'g')) AS q FROM turns),
  g AS (SELECT *, len(list_filter(words, lambda t: contains(q, t))) >= least(3, len(words)) AS grounded FROM w)"""


@query(
    "grounded_labels",
    f"""WITH {_FINISHED} SELECT conv_id, turn, grounded,
      CASE WHEN NOT grounded THEN 'UNCERTAIN' WHEN turn % 3 = 1 THEN 'FACT' ELSE 'INFERENCE' END AS classification,
      CASE WHEN NOT grounded THEN 'LOW' WHEN turn % 2 = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
      CASE WHEN conv_id % 2 = 0 THEN 'STANDALONE' ELSE 'NOT_CLEAR' END AS accounting_basis, sha256(quote) AS quote_sha256 FROM g""",
)
def grounded_labels(spark, sf_dir) -> DataFrame:
    """Labels of each assistant turn; what the turn before does not ground is uncertain."""
    rows = V.turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.col("claim").alias("fact"),
        F.array().cast("array<string>").alias("data_points"), F.col("quote").alias("excerpt"),
        F.when(F.col("turn") % 3 == 1, " fact ").otherwise("opinion").alias("classification"),
        F.when(F.col("turn") % 2 == 1, "high").alias("confidence"),
        F.when(F.col("conv_id") % 2 == 0, "standalone").otherwise("?").alias("accounting_basis"),
    )
    return qa.grounded_labels(rows).select(
        "conv_id", "turn", "grounded", "classification", "confidence", "accounting_basis",
        F.sha2("supporting_quote", 256).alias("quote_sha256"),
    )


@query(
    "known_answers",
    """SELECT o_orderkey AS finding_id, o_custkey % 25 AS question_id FROM orders WHERE o_custkey % 25 < 10 AND o_custkey % 2 = 0""",
)
def known_answers(spark, sf_dir) -> DataFrame:
    """Answers to questions that were asked."""
    raw = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("finding_id"), (F.col("o_custkey") % 25).alias("question_id"),
        F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("specialist"),
    )
    asked = V.table(spark, sf_dir, "nation").where("n_nationkey < 10").select(
        F.lit("a").alias("specialist"), F.col("n_nationkey").cast("long").alias("question_id")
    )
    return qa.known_answers(raw, asked).select("finding_id", "question_id")
