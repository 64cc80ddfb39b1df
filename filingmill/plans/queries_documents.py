"""Queries on documents, chunks, retrieval, claims and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingmill import schemas
from filingmill.functions import text as T
from filingmill.operators import chunks as C
from filingmill.operators import conclusions as K
from filingmill.operators import dedupe, facts, qa, quotes, report, retrieve
from filingmill.plans import flows
from filingmill.plans.catalog import query
from filingmill.plans.queries_metrics import FIRSTS_SQL
from filingmill.rules import research as R
from filingmill.rules import words as W
from filingmill.session import fixed_table, shared_folder, stored
from filingmill.sources import testviews as V
from filingmill.streaming import incremental


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ----------------------------------------------------------------------- pages

_SPACE = r"[\s\x{00a0}\x{feff}]"

PAGES_SQL = rf"""
raw_pages AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang AS company_id, i,
    regexp_replace(string_split(text, chr(10))[i], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text,
    len(string_split(text, chr(10))) - 1 AS page_count
  FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
pages_x AS (SELECT document_id, company_id, CAST(i AS INTEGER) AS page_num, text,
    CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS INTEGER) AS char_count
  FROM raw_pages WHERE i <= page_count OR text <> '')"""


@query(
    "page_split",
    f"WITH {PAGES_SQL} SELECT document_id, page_num, text, char_count, char_count = 0 AS is_empty FROM pages_x",
)
def page_split(spark, sf_dir) -> DataFrame:
    """Document text -> page rows."""
    return C.split_pages(V.documents(spark, sf_dir), "\n").drop("company_id")


@query(
    "page_stats",
    f"""WITH {PAGES_SQL}, s AS (SELECT document_id, count(*) AS page_count, CAST(sum(char_count) AS BIGINT) AS total_chars,
      count(*) FILTER (char_count > 0) AS filled_pages, count(*) FILTER (char_count = 0) AS empty_pages
      FROM pages_x GROUP BY 1), t AS (SELECT *, CASE WHEN total_chars < 30 * greatest(page_count, 1) THEN 'scanned'
      WHEN filled_pages = 0 THEN 'empty' WHEN empty_pages > 0 THEN 'partial' ELSE 'complete' END AS extraction_status FROM s)
    SELECT *, CASE WHEN extraction_status IN ('complete', 'partial') THEN 'complete' ELSE 'failed' END AS db_status FROM t""",
)
def page_stats(spark, sf_dir) -> DataFrame:
    """Totals and extraction status per document."""
    return C.page_stats(C.split_pages(V.documents(spark, sf_dir), "\n"))


@query("chunk_build")
def chunk_build(spark, sf_dir) -> DataFrame:
    """Pages grouped, split and numbered into chunks, with header chunks."""
    documents = V.documents(spark, sf_dir)
    headers = documents.select(
        "document_id", "company_id",
        F.concat(F.lit("Source: "), "source_name").alias("header"),
    )
    return C.build_chunks(C.split_pages(documents, "\n"), headers)


@query("document_preview")
def document_preview(spark, sf_dir) -> DataFrame:
    """Preview text of every document."""
    documents = V.documents(spark, sf_dir)
    headers = documents.select(
        "document_id", "company_id",
        F.concat(F.lit("Source: "), "source_name").alias("header"),
    )
    pages = C.split_pages(documents, "\n")
    return C.document_preview(pages, C.build_chunks(pages, headers), headers)


@query(
    "chunk_search",
    f"""WITH {V.CHUNKS_SQL}, h AS (SELECT * FROM chunks WHERE company_id = 'en' AND contains(lower(content), 'that the'))
    SELECT h.document_id, CAST(chunk_index AS INTEGER) AS chunk_index, content, string_split(d.text, chr(10))[1] AS document_title
    FROM h JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.document_id  """,
)
def chunk_search(spark, sf_dir) -> DataFrame:
    """All chunks of a company that hold a phrase."""
    return C.search_chunks(
        V.paragraph_chunks(spark, sf_dir), V.documents(spark, sf_dir),
        " That THE ", "en",
    ).select("document_id", "chunk_index", "content", "document_title")


@query(
    "chunk_range",
    f"""WITH {V.CHUNKS_SQL} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, content FROM chunks
    WHERE document_id = '17' AND chunk_index BETWEEN 2 AND 9 ORDER BY chunk_index""",
)
def chunk_range(spark, sf_dir) -> DataFrame:
    """Chunks of one document in a page range."""
    return C.chunk_range(
        V.paragraph_chunks(spark, sf_dir), "17", page_from=2, page_to=9
    ).select("document_id", "chunk_index", "content")


@query(
    "page_gaps",
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, i AS page_num FROM (
      SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))) - 1)) AS i
      FROM documents) WHERE length(l[i]) < 100""",
)
def page_gaps(spark, sf_dir) -> DataFrame:
    """Pages that no chunk of at least a hundred characters covers."""
    chunks = V.paragraph_chunks(spark, sf_dir).withColumn(
        "content", F.replace("content", F.lit(".\n"), F.lit(". "))
    ).where(F.length("content") >= 100)
    return C.missing_pages(chunks, V.documents(spark, sf_dir)).select(
        "document_id", F.col("page_num").cast("bigint").alias("page_num")
    )


@query(
    "chunk_contiguity",
    f"""WITH {V.CHUNKS_SQL}, c AS (SELECT document_id, CASE WHEN length(content) < 5 THEN 0 ELSE chunk_index - 1 END AS x FROM chunks),
      r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY x) - 1 AS p FROM c)
    SELECT document_id, count(*) AS n_chunks, bool_and(x = p) AS contiguous FROM r GROUP BY 1""",
)
def chunk_contiguity(spark, sf_dir) -> DataFrame:
    """Do chunk indexes run without gaps and repeats?"""
    index = F.when(F.length("content") < 5, 0).otherwise(
        F.col("chunk_index") - 1
    )
    chunks = V.paragraph_chunks(spark, sf_dir).withColumn("chunk_index", index)
    return C.contiguity(chunks).select(
        "document_id", "n_chunks", "contiguous"
    )


# ------------------------------------------------------------------- retrieval

UNITS_SQL = rf"""{V.CHUNKS_SQL},
lines AS (SELECT company_id, document_id, chunk_index, i AS line_start,
    regexp_replace(l[i], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS a, len(l) AS n,
    CASE WHEN i < len(l) THEN regexp_replace(l[i + 1], '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE '' END AS b
  FROM (SELECT *, string_split(content, chr(10)) AS l,
    unnest(generate_series(1, len(string_split(content, chr(10))))) AS i FROM chunks)),
units AS (SELECT *, chunk_index || ':' || line_start || '-' || line_end AS unit_id FROM (
    SELECT company_id, document_id, chunk_index, line_start, line_start AS line_end, 1 AS size, a AS content FROM lines
    UNION ALL SELECT company_id, document_id, chunk_index, line_start, least(n, line_start + 1), 2,
      concat_ws(' ', nullif(a, ''), nullif(b, '')) FROM lines)
  WHERE length(content) >= 24)"""

_Q_ROWS = [(s, i, q) for s, qs in V.TEST_QUERIES.items() for i, q in enumerate(qs)]


def _tokens(q: str) -> list[str]:
    return [t for t in q.split(" ") if len(t) > 2 and t not in W.QUERY_STOP_WORDS]


SCORED_SQL = rf"""
q(section_key, query_index, phrase, tokens) AS (VALUES {", ".join(f"('{s}', {i}, '{q}', {_sql_list(_tokens(q)) if _tokens(q) else "CAST([] AS VARCHAR[])"})" for s, i, q in _Q_ROWS)}),
norm AS (SELECT *, trim(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}%₹]+', ' ', 'g')) AS t FROM units),
pieces AS (SELECT *, string_split_regex(t, '[^a-z0-9_]+') AS p, CASE WHEN regexp_matches(content, '\d') THEN 2 ELSE 0 END AS digit FROM norm),
scored AS (SELECT *, digit + hit AS score FROM (SELECT pieces.*, q.*,
    CASE WHEN contains(t, phrase) THEN 60 ELSE 0 END
    + coalesce(list_sum(list_transform(tokens, lambda k: least(8, len(list_filter(p, lambda x: x = k))))), 0) AS hit
  FROM pieces, q))"""


@query(
    "evidence_units",
    f"WITH {UNITS_SQL} SELECT document_id, unit_id, CAST(size AS INTEGER) AS size, content FROM units",
)
def evidence_units(spark, sf_dir) -> DataFrame:
    """Candidate units: lines alone and in pairs."""
    return retrieve.evidence_units(V.paragraph_chunks(spark, sf_dir)).select(
        "document_id", "unit_id", "size", "content"
    )


@query(
    "lexical_score",
    f"""WITH {UNITS_SQL}, {SCORED_SQL} SELECT document_id, unit_id, CAST(size AS INTEGER) AS size, section_key,
      CAST(query_index AS INTEGER) AS query_index, CAST(score AS INTEGER) AS score FROM scored WHERE hit > 0""",
)
def lexical_score(spark, sf_dir) -> DataFrame:
    """Score of every unit and query with a hit."""
    return retrieve.lexical_scores(
        V.paragraph_chunks(spark, sf_dir), V.TEST_QUERIES
    ).select(
        "document_id", "unit_id", "size", "section_key", "query_index", "score"
    )


_MANY = [(s, i, q) for s, qs in V.MANY_QUERIES.items() for i, q in enumerate(qs)]


@query(
    "many_query_scores",
    rf"""WITH {UNITS_SQL}, q(section_key, query_index, phrase) AS (VALUES {", ".join(f"('{s}', {i}, '{q}')" for s, i, q in _MANY)}),
    k(section_key, query_index, token) AS (VALUES {", ".join(f"('{s}', {i}, '{t}')" for s, i, q in _MANY for t in _tokens(q))}),
    norm AS (SELECT document_id, unit_id, size, chunk_index, line_start, content,
      trim(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}%₹]+', ' ', 'g')) AS t FROM units),
    w AS (SELECT chunk_index, line_start, size, document_id, unnest(string_split_regex(t, '[^a-z0-9_]+')) AS token FROM norm),
    n AS (SELECT chunk_index, line_start, size, document_id, token, least(8, count(*)) AS points FROM w
      WHERE token IN (SELECT token FROM k) GROUP BY ALL),
    p AS (SELECT document_id, chunk_index, line_start, size, section_key, query_index, points FROM n JOIN k USING (token)
      UNION ALL SELECT document_id, chunk_index, line_start, size, section_key, query_index, 60 FROM norm, q WHERE contains(t, phrase))
    SELECT document_id, CAST(size AS INTEGER) AS size, section_key, CAST(query_index AS INTEGER) AS query_index, unit_id,
      CAST(sum(points) + any_value(CASE WHEN regexp_matches(content, '\d') THEN 2 ELSE 0 END) AS INTEGER) AS score
    FROM p JOIN norm USING (document_id, chunk_index, line_start, size) GROUP BY document_id, chunk_index, line_start, size, unit_id, section_key, query_index""",
)
def many_query_scores(spark, sf_dir) -> DataFrame:
    """Scores of 163 queries at once, through the index."""
    return retrieve.lexical_scores(V.paragraph_chunks(spark, sf_dir), V.MANY_QUERIES).select(
        "document_id", "unit_id", "size", "section_key", "query_index", "score"
    )


SELECT_SQL = f"""{UNITS_SQL}, {SCORED_SQL},
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key, query_index
    ORDER BY score DESC, chunk_index, line_start, size) AS rank FROM scored WHERE score > 0) WHERE rank <= 4),
late AS (SELECT document_id, section_key, chunk_index, line_start, size, unit_id, content, sum(score) AS total
  FROM scored GROUP BY ALL HAVING sum(score) > 0),
keys AS (SELECT document_id, section_key, unit_id, chunk_index, line_start, size, content, 0 AS phase, query_index AS step, rank FROM early
  UNION ALL SELECT document_id, section_key, unit_id, chunk_index, line_start, size, content, 1, 0, -total FROM late),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key, unit_id
    ORDER BY phase, step, rank, chunk_index, line_start, size) AS r1 FROM keys) WHERE r1 = 1),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key, chunk_index
    ORDER BY phase, step, rank, chunk_index, line_start, size) AS r2 FROM k1) WHERE r2 <= 6),
packs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key
    ORDER BY phase, step, rank, chunk_index, line_start, size) AS r3 FROM k2) WHERE r3 <= 32)"""
SELECT_SQL = SELECT_SQL.replace(
    "FROM scored GROUP BY ALL HAVING",
    "FROM scored GROUP BY document_id, section_key, chunk_index, line_start, size, unit_id, content HAVING",
)


@query(
    "evidence_select",
    f"WITH {SELECT_SQL} SELECT document_id, section_key, unit_id, content FROM packs",
)
def evidence_select(spark, sf_dir) -> DataFrame:
    """Evidence pack of every section and document."""
    return retrieve.select_evidence(
        V.paragraph_chunks(spark, sf_dir), V.TEST_QUERIES
    ).select("document_id", "section_key", "unit_id", "content")


@query(
    "evidence_gate",
    f"""WITH {SELECT_SQL}, g AS (SELECT document_id, section_key, count(*) AS n_units, count(DISTINCT chunk_index) AS n_chunks
      FROM packs GROUP BY 1, 2), w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest({_sql_list(V.TEST_QUERIES)}) AS section_key FROM documents)
    SELECT w.document_id, w.section_key, coalesce(n_units, 0) AS n_units, coalesce(n_chunks, 0) AS n_chunks,
      coalesce(n_units >= 12 AND n_chunks >= 2, false) AS sufficient FROM w LEFT JOIN g USING (document_id, section_key)""",
)
def evidence_gate(spark, sf_dir) -> DataFrame:
    """Is each pack sufficient?"""
    packs = retrieve.selected_units(
        V.paragraph_chunks(spark, sf_dir), V.TEST_QUERIES
    )
    documents = V.documents(spark, sf_dir).select("company_id", "document_id")
    return retrieve.evidence_gate(packs, documents, list(V.TEST_QUERIES)).drop(
        "company_id"
    )


@query(
    "chunk_select",
    f"""WITH {V.CHUNKS_SQL}, q(section_key, query_index, phrase, tokens) AS (VALUES
      {", ".join(f"('{s}', {i}, '{q}', {_sql_list(_tokens(q)) if _tokens(q) else 'CAST([] AS VARCHAR[])'})" for s, i, q in [*_Q_ROWS, ('_basis', 0, 'that the'), ('_basis', 1, 'nicht')])}),
    n AS (SELECT *, trim(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}%₹]+', ' ', 'g')) AS t FROM chunks),
    p AS (SELECT *, string_split_regex(t, '[^a-z0-9_]+') AS p FROM n),
    s AS (SELECT document_id, chunk_index, section_key, query_index, CASE WHEN contains(t, phrase) THEN 18 ELSE 0 END
      + coalesce(list_sum(list_transform(tokens, lambda k: least(8, len(list_filter(p, lambda x: x = k))))), 0) AS score FROM p, q),
    tot AS (SELECT document_id, section_key, chunk_index, sum(score) AS total FROM s GROUP BY 1, 2, 3 HAVING sum(score) > 0),
    ph AS (SELECT document_id, 'english' AS section_key, chunk_index, 0 AS phase, 0 AS step, rn AS rank FROM (SELECT *,
        row_number() OVER (PARTITION BY document_id ORDER BY total DESC, chunk_index) AS rn FROM tot WHERE section_key = '_basis') WHERE rn <= 2
      UNION ALL SELECT document_id, section_key, chunk_index, 1, query_index, rn FROM (SELECT *, row_number() OVER
        (PARTITION BY document_id, section_key, query_index ORDER BY score DESC, chunk_index) AS rn FROM s
        WHERE score > 0 AND section_key <> '_basis') WHERE rn <= 2
      UNION ALL SELECT document_id, section_key, chunk_index, 2, 0, -total FROM tot WHERE section_key <> '_basis'),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key, chunk_index
      ORDER BY phase, step, rank, chunk_index) AS r FROM ph) WHERE r = 1),
    c AS (SELECT document_id, section_key, chunk_index, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_key
      ORDER BY phase, step, rank, chunk_index) AS place FROM d) WHERE place <= 8),
    nb AS (SELECT c.document_id, c.section_key, c.chunk_index + x.o AS chunk_index, min(c.place * 2 + x.side) AS ord
      FROM c, (VALUES (-1, 0), (1, 1)) x(o, side) JOIN chunks k ON k.document_id = c.document_id AND k.chunk_index = c.chunk_index + x.o
      WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.document_id = c.document_id AND z.section_key = c.section_key AND z.chunk_index = c.chunk_index + x.o)
      GROUP BY 1, 2, 3),
    nn AS (SELECT nb.document_id, nb.section_key, nb.chunk_index, m.n + row_number() OVER (PARTITION BY nb.document_id, nb.section_key ORDER BY ord) AS place
      FROM nb JOIN (SELECT document_id, section_key, count(*) AS n FROM c GROUP BY 1, 2) m USING (document_id, section_key))
    SELECT document_id, section_key, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(place AS INTEGER) AS place FROM c
    UNION ALL SELECT document_id, section_key, CAST(chunk_index AS INTEGER), CAST(place AS INTEGER) FROM nn WHERE place <= 8""",
)
def chunk_select(spark, sf_dir) -> DataFrame:
    """Best chunks per section: basis words, queries, sums, neighbours."""
    return retrieve.select_chunks(
        V.paragraph_chunks(spark, sf_dir), V.TEST_QUERIES,
        basis_sections=["english"], basis_queries=["that the", "nicht"],
    ).drop("company_id")


# ------------------------------------------------------------------------ HTML

_CLEAN = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g')"


@query(
    "html_paragraphs",
    f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(unnest(regexp_extract_all({_CLEAN}, '(?is)<p[^>]*>(.*?)</p>', 1)),
      '<[^>]+>', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS statement FROM pages)
    SELECT page_id, statement FROM p
    WHERE length(statement) > 50 AND regexp_matches(statement, '(?i)heon|eaux|keit|aim|plan')""",
)
def html_paragraphs(spark, sf_dir) -> DataFrame:
    """Paragraphs of web pages that hold one of the wanted words."""
    documents = V.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("document_id"), F.col("url").alias("company_id"),
        F.col("html").alias("payload"),
    )
    return facts.guidance_statements(
        documents, ["heon", "eaux", "keit", "aim", "plan"]
    ).select(F.col("document_id").alias("page_id"), "statement")


@query(
    "visible_text",
    f"""SELECT page_id, trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g')) AS text FROM pages""",
)
def visible_text(spark, sf_dir) -> DataFrame:
    """Visible text of web pages."""
    return V.table(spark, sf_dir, "pages").select(
        "page_id", T.visible_text(facts.clean_html(F.col("html"))).alias("text")
    )


@query(
    "entity_decode",
    r"""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'),
      '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS text FROM pages""",
)
def entity_decode(spark, sf_dir) -> DataFrame:
    """Pages with their entities decoded."""
    return V.table(spark, sf_dir, "pages").select(
        "page_id", T.decode_entities(F.col("html")).alias("text")
    )


# ---------------------------------------------------------------- number tokens

_SIGNED = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def _nums(col: str) -> str:
    return f"list_transform(regexp_extract_all({col}, '{_SIGNED}'), lambda x: replace(x, ',', ''))"


def _material(col: str) -> str:
    return (
        f"list_filter({_nums(col)}, lambda x: NOT regexp_full_match(x, '(19|20)\\d\\d') AND length(x) > 1)"
    )


def _grouped(col: str) -> str:
    return (
        f"list_transform(regexp_extract_all({col}, '\\d[\\d,]*(?:\\.\\d+)?(?:%|[xX])?'),"
        " lambda x: lower(replace(x, ',', '')))"
    )


@query(
    "numeric_tokens",
    f"""SELECT doc_id, array_to_string({_nums('text')}, ' ') AS signed, array_to_string({_material('text')}, ' ') AS material,
      array_to_string({_grouped('text')}, ' ') AS grouped FROM documents""",
)
def numeric_tokens(spark, sf_dir) -> DataFrame:
    """The three kinds of number tokens of every document."""
    text = F.col("text")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(T.signed_numbers(text), " ").alias("signed"),
        F.array_join(T.material_numbers(text), " ").alias("material"),
        F.array_join(T.grouped_numbers(text), " ").alias("grouped"),
    )


# -------------------------------------------------------------------- findings


@query(
    "number_grounding",
    f"""WITH {V.CLAIMS_SQL}, m AS (SELECT *, list_filter({_material('fact')}, lambda x: NOT list_contains({_material('supporting_quote')}, x)) AS missing FROM claims)
    SELECT finding_id, CASE WHEN supporting_quote = '' THEN 'MISSING_EVIDENCE' ELSE 'NUMERICAL_MISMATCH' END AS status,
      CASE WHEN supporting_quote = '' THEN 'No supporting quote captured for this finding.'
        ELSE 'Numbers not found in cited evidence: ' || array_to_string(missing, ', ') END AS detail, 'HIGH' AS severity
    FROM m WHERE NOT insufficient_evidence AND (supporting_quote = '' OR len(missing) > 0)""",
)
def number_grounding(spark, sf_dir) -> DataFrame:
    """Findings whose numbers are not in their quote."""
    return V.findings(spark, sf_dir).select(
        "finding_id", qa.grounding_note().alias("n")
    ).where("n IS NOT NULL").select("finding_id", "n.*")


@query(
    "unsupported",
    f"""WITH {V.CLAIMS_SQL} SELECT finding_id, CASE WHEN uncited THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM claims WHERE NOT insufficient_evidence AND (uncited OR thin)""",
)
def unsupported(spark, sf_dir) -> DataFrame:
    """Findings without citation, or without analysis and implication."""
    return V.findings(spark, sf_dir).select(
        "finding_id", qa.support_note().alias("n")
    ).where("n IS NOT NULL").select("finding_id", "n.severity")


def _words_sql(col: str) -> str:
    stop = _sql_list(W.CLAIM_STOP_WORDS)
    return (
        f"list_filter(string_split(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),"
        f" lambda w: length(w) > 3 AND NOT list_contains({stop}, w))"
    )


@query(
    "fact_grounding",
    f"""WITH {V.TURNS_SQL}, w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(claim), '[^a-z0-9%₹]+', ' ', 'g')), ' '),
      lambda t: length(t) > 3) AS words, trim(regexp_replace(lower(quote), '[^a-z0-9%₹]+', ' ', 'g')) AS q FROM turns)
    SELECT conv_id, turn, len(list_filter(words, lambda t: contains(q, t))) >= least(3, len(words)) AS grounded FROM w""",
)
def fact_grounding(spark, sf_dir) -> DataFrame:
    """Is each assistant turn grounded in the turn before it?"""
    none = F.array().cast("array<string>")
    return V.turn_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        T.fact_grounded(F.col("claim"), none, F.col("quote")).alias("grounded"),
    )


@query(
    "claim_support",
    f"""WITH {V.TURNS_SQL}, o AS (SELECT conv_id, turn, {_words_sql('claim')} AS w, lower(quote) AS q FROM turns),
    u AS (SELECT conv_id, turn, q, list_filter(list_transform(generate_series(1, len(w)), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END),
      lambda x: x IS NOT NULL) AS w FROM o)
    SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN false ELSE len(list_filter(w, lambda t: contains(q, t))) >= least(4, len(w)) END AS supported FROM u""",
)
def claim_support(spark, sf_dir) -> DataFrame:
    """Does the turn before support the first claim words?"""
    return V.turn_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        T.claim_supported(F.col("claim"), F.col("quote")).alias("supported"),
    )


@query(
    "contradictions",
    """WITH g AS (SELECT o_custkey AS company_id, year(o_orderdate) AS period, count(*) AS n_results, min(o_totalprice) AS low,
      max(o_totalprice) AS high FROM orders GROUP BY 1, 2)
    SELECT o.o_custkey AS company_id, CAST(year(o.o_orderdate) AS INTEGER) AS period, count(DISTINCT o.o_orderkey) AS n_results,
      min(g.low) AS low, max(g.high) AS high FROM orders o JOIN g ON g.company_id = o.o_custkey AND g.period = year(o.o_orderdate)
    WHERE EXISTS (SELECT 1 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND year(a.o_orderdate) = year(b.o_orderdate)
      AND a.o_orderkey < b.o_orderkey WHERE a.o_custkey = o.o_custkey AND year(a.o_orderdate) = year(o.o_orderdate)
      AND abs(a.o_totalprice - b.o_totalprice) / greatest(abs(a.o_totalprice), abs(b.o_totalprice), 0.0001) > 0.05)
    GROUP BY 1, 2""",
)
def contradictions(spark, sf_dir) -> DataFrame:
    """Groups of results that contradict each other."""
    results = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.year("o_orderdate").alias("period"),
        F.col("o_totalprice").alias("value"),
    )
    return qa.contradictory_groups(results, ["company_id", "period"]).drop("gap")


@query(
    "contradicted_findings",
    """SELECT a.o_orderkey AS finding_id, min(b.o_totalprice) AS later_low, max(b.o_totalprice) AS later_high
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey
    GROUP BY 1 HAVING bool_or(abs(a.o_totalprice - b.o_totalprice) / greatest(abs(a.o_totalprice), abs(b.o_totalprice), 0.0001) > 0.05)""",
)
def contradicted_findings(spark, sf_dir) -> DataFrame:
    """Results that a later result of the same group contradicts."""
    results = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderstatus").alias("basis"),
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_totalprice").alias("value"),
    )
    return qa.contradicted_results(
        results, ["company_id", "basis"], "finding_id"
    ).select("finding_id", "later_low", "later_high")


@query(
    "qa_summary",
    f"""WITH {V.CLAIMS_SQL}, n AS (SELECT *, CASE WHEN insufficient_evidence THEN 0 WHEN supporting_quote = '' THEN 1
        WHEN len(list_filter({_material('fact')}, lambda x: NOT list_contains({_material('supporting_quote')}, x))) > 0 THEN 1 ELSE 0 END AS grounding,
        CASE WHEN m = 1 THEN 1 ELSE 0 END AS mixed,
        CASE WHEN NOT insufficient_evidence AND uncited THEN 1 ELSE 0 END AS no_cite,
        CASE WHEN NOT insufficient_evidence AND thin AND NOT uncited THEN 1 ELSE 0 END AS is_thin FROM claims),
      x AS (SELECT *, EXISTS (SELECT 1 FROM claims b WHERE b.company_id = n.company_id AND b.document_id = n.document_id
        AND b.finding_pos > n.finding_pos AND abs(n.result - b.result) / greatest(abs(n.result), abs(b.result), 0.0001) > 0.05) AS contra FROM n)
    SELECT company_id, document_id, count(*) AS total_findings,
      CAST(sum(grounding + mixed * 2 + no_cite + is_thin + CASE WHEN contra THEN 1 ELSE 0 END) AS BIGINT) AS n_notes,
      count(*) FILTER (grounding + mixed + no_cite > 0) AS failed,
      count(*) - count(*) FILTER (grounding + mixed + no_cite > 0) AS passed FROM x GROUP BY 1, 2""",
)
def qa_summary(spark, sf_dir) -> DataFrame:
    """Passed, failed and notes of every run."""
    return flows.validate_findings(V.findings(spark, sf_dir))["summary"]


@query(
    "run_totals",
    f"""WITH {V.CLAIMS_SQL} SELECT specialist, count(*) AS n_findings, count(*) FILTER (NOT insufficient_evidence) AS n_supported,
      count(*) FILTER (insufficient_evidence) AS n_insufficient FROM claims GROUP BY 1""",
)
def run_totals(spark, sf_dir) -> DataFrame:
    """Findings per specialist."""
    return qa.run_totals(V.findings(spark, sf_dir), ["specialist"])


@query(
    "missing_questions",
    """SELECT c_custkey AS company_id, n_nationkey AS question_id FROM customer, (SELECT n_nationkey FROM nation)
    WHERE n_nationkey < 12 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
      AND month(o_orderdate) = n_nationkey + 1 AND o_orderpriority <> '5-LOW')""",
)
def missing_questions(spark, sf_dir) -> DataFrame:
    """Questions (one per month and customer) without a supported answer."""
    asked = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.explode(F.sequence(F.lit(0), F.lit(11))).alias("question_id"),
    )
    answers = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        (F.month("o_orderdate") - 1).alias("question_id"),
        (F.col("o_orderpriority") == "5-LOW").alias("insufficient_evidence"),
    )
    return qa.missing_questions(answers, asked, ["company_id", "question_id"])


# ------------------------------------------------------------------- citations

CITED_SQL = f"""{SELECT_SQL}, cited AS (SELECT lang AS company_id, CAST(doc_id AS VARCHAR) AS document_id, 'english' AS section_key,
    ['1:1-1', ' 1:1-2 ', 'chunk 2', '999', 'none'] AS ids FROM documents),
ids AS (SELECT document_id, section_key, i AS cite_pos, trim(ids[i]) AS raw FROM (SELECT *, unnest(generate_series(1, 5)) AS i FROM cited)),
res AS (SELECT ids.document_id, cite_pos, p.unit_id, p.chunk_index, p.line_start, p.content FROM ids JOIN packs p USING (document_id, section_key) WHERE p.unit_id = raw
  UNION ALL SELECT ids.document_id, cite_pos, p.unit_id, p.chunk_index, p.line_start, p.content FROM ids JOIN packs p USING (document_id, section_key)
  WHERE NOT EXISTS (SELECT 1 FROM packs z WHERE z.document_id = ids.document_id AND z.section_key = ids.section_key AND z.unit_id = raw)
    AND CAST(p.chunk_index AS VARCHAR) = regexp_extract(raw, '\\d+'))"""


def _cited(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    packs = stored(
        retrieve.select_evidence(
            V.paragraph_chunks(spark, sf_dir), V.TEST_QUERIES
        )
    )
    ids = F.array(*[F.lit(i) for i in ["1:1-1", " 1:1-2 ", "chunk 2", "999", "none"]])
    cited = V.documents(spark, sf_dir).select(
        "company_id", "document_id", F.lit("english").alias("section_key"),
        ids.alias("evidence_ids"),
    )
    return cited, packs


@query(
    "citations",
    f"""WITH {CITED_SQL}, f AS (SELECT document_id, unit_id, chunk_index, min(cite_pos) AS c, min(line_start) AS l, min(content) AS content FROM res GROUP BY 1, 2, 3)
    SELECT document_id, string_agg(DISTINCT CAST(chunk_index AS VARCHAR), ',' ORDER BY CAST(chunk_index AS VARCHAR)) AS chunks,
      string_agg(content, ' ' || chr(10) || ' ' ORDER BY c, chunk_index, l, content) AS excerpt FROM f GROUP BY 1""",
)
def citations(spark, sf_dir) -> DataFrame:
    """Resolve cited ids to chunks and the excerpt they show."""
    cited, packs = _cited(spark, sf_dir)
    units = qa.cited_units(cited, packs, ["document_id"])
    out = qa.citations(units, ["document_id"])
    chunks = F.array_sort(
        F.transform("citations", lambda c: c["chunk_index"].cast("string"))
    )
    return out.select(
        "document_id", F.array_join(chunks, ",").alias("chunks"), "excerpt"
    )


@query(
    "quote_fallback",
    f"""WITH {SELECT_SQL}, asked AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lower(x) AS needle FROM (
        SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents) WHERE length(trim(x)) > 40)
    SELECT document_id, section_key, unit_id FROM (SELECT a.document_id, p.section_key, p.unit_id, row_number() OVER (
        PARTITION BY a.document_id, p.section_key ORDER BY p.chunk_index, p.line_start, p.size) AS rn
      FROM asked a JOIN packs p ON p.document_id = a.document_id AND contains(lower(p.content), needle)) WHERE rn = 1""",
)
def quote_fallback(spark, sf_dir) -> DataFrame:
    """First unit of each pack that holds a document's first line."""
    _, packs = _cited(spark, sf_dir)
    quotes = V.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("company_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.expr("split(text, '\n')[0]").alias("supporting_quote"),
    )
    return qa.quote_fallback(quotes, packs, ["document_id"]).select(
        "document_id", "section_key", "unit_id"
    )


@query(
    "document_quotes",
    f"""WITH {V.CHUNKS_SQL}, s AS (SELECT DISTINCT document_id, lower(x) AS needle FROM (
        SELECT document_id, unnest(string_split(content, chr(10))) AS x FROM chunks) WHERE length(trim(x)) > 40)
    SELECT s.document_id, md5(needle) AS quote_md5, CAST(min(chunk_index) AS INTEGER) AS first_chunk, count(*) AS n_chunks
    FROM s JOIN chunks c ON c.document_id = s.document_id AND contains(lower(c.content), needle) GROUP BY s.document_id, needle""",
)
def document_quotes(spark, sf_dir) -> DataFrame:
    """Every sentence of 40 characters or more, sought in all chunks of its document."""
    chunks = V.paragraph_chunks(spark, sf_dir)
    asked = chunks.select(
        *quotes.DOC, F.explode(F.split("content", "\n")).alias("supporting_quote")
    )
    return quotes.quote_places(asked, chunks).groupBy("document_id", "needle").agg(
        F.min("chunk_index").cast("int").alias("first_chunk"), F.count(F.lit(1)).alias("n_chunks")
    ).select("document_id", F.md5("needle").alias("quote_md5"), "first_chunk", "n_chunks")


@query(
    "best_excerpt",
    f"""WITH {SELECT_SQL}, c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10))[1] AS claim FROM documents),
    w0 AS (SELECT document_id, claim, {_words_sql('claim')} AS w FROM c),
    w1 AS (SELECT document_id, claim, {_grouped('claim')} AS nums, list_filter(list_transform(generate_series(1, len(w)),
      lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS w FROM w0),
    j AS (SELECT w1.document_id, p.unit_id, p.content, p.chunk_index, p.line_start, p.size, nums, w,
      len(list_filter(w, lambda t: contains(trim(regexp_replace(lower(p.content), '\\s+', ' ', 'g')), t))) AS hits
      FROM w1 JOIN packs p ON p.document_id = w1.document_id AND p.section_key = 'english'
      WHERE len(list_filter(nums, lambda t: NOT list_contains({_grouped('p.content')}, t))) = 0),
    r AS (SELECT *, hits * 3 + len(nums) * 4 AS score FROM j WHERE hits >= least(4, len(w)))
    SELECT document_id, excerpt_score, content AS excerpt FROM (SELECT *, score AS excerpt_score, row_number() OVER (PARTITION BY document_id
      ORDER BY score DESC, length(content), chunk_index, line_start) AS rn FROM r) WHERE rn = 1""",
)
def best_excerpt(spark, sf_dir) -> DataFrame:
    """Best supporting unit for the first line of each document."""
    packs = retrieve.select_evidence(
        V.paragraph_chunks(spark, sf_dir), {"english": V.TEST_QUERIES["english"]}
    )
    claims = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.split("text", "\n")[0].alias("claim"),
    )
    place = F.struct("chunk_index", "line_start")
    units = packs.withColumn("cite_pos", place)
    return K.best_excerpt(claims, units, ["document_id"]).select(
        "document_id", "excerpt_score", "excerpt"
    )


# ---------------------------------------------------------------------- claims


@query(
    "financial_figure",
    f"""WITH {V.HEADLINES_SQL}, t AS (SELECT item_id, lower(title) AS t FROM headlines)
    SELECT item_id, (regexp_matches(t, '[₹%]') OR regexp_matches(t, '\\b(revenue|profit|pat|ebitda|eps|cash|debt|borrowings|capex|margin|receivables|inventory|payables|crore|million|billion)\\b'))
      AND regexp_matches(t, '\\d') AS figure, contains(t, 'approves dividend') AS interpreted FROM t""",
)
def financial_figure(spark, sf_dir) -> DataFrame:
    """Headlines with a financial figure, and with an interpretive phrase."""
    title = F.col("title")
    return V.headlines(spark, sf_dir).select(
        "item_id",
        T.is_financial_figure(title, F.lit(""), F.lit(False)).alias("figure"),
        T.has_interpretation(title, F.lit("plain"), ["approves dividend"])
        .alias("interpreted"),
    )


@query(
    "subject_proximity",
    """SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false
      ELSE o_orderpriority <> '1-URGENT' END AS ok FROM orders""",
)
def subject_proximity(spark, sf_dir) -> DataFrame:
    """Do the figures of a claim stand near its subject?"""
    amount = F.col("o_custkey").cast("string")
    claim = F.concat(F.lit("Retail Segment earned 1,1"), amount)
    far = F.when(F.col("o_orderstatus") == "O", F.repeat(F.lit("x "), F.lit(200))).otherwise("")
    name = F.when(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"),
        "Wholesale",
    ).otherwise("RETAIL   segment")
    excerpt = F.concat(name, F.lit(" revenue "), far, F.lit("of ₹11"), amount)
    return V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"),
        T.subject_supported(claim, excerpt).alias("ok"),
    )


@query(
    "section_scope",
    f"""WITH {V.HEADLINES_SQL} SELECT item_id, regexp_matches(lower(title), '\\b(revenue|income|ebitda|profit|pat|margin|eps|tax|expense|earnings)\\b') AS financial,
      regexp_matches(lower(title), '\\b(grew|growth|increase|improv|record|achiev|strength|expand|benefit|launch|commission|complet)') AS positives FROM headlines""",
)
def section_scope(spark, sf_dir) -> DataFrame:
    """Is a headline in the scope of two report sections?"""
    return V.headlines(spark, sf_dir).select(
        "item_id",
        K.in_scope(F.lit("financial"), F.col("title")).alias("financial"),
        K.in_scope(F.lit("positives"), F.col("title")).alias("positives"),
    )


@query(
    "coerced_labels",
    """SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 'FACT' ELSE 'INFERENCE' END AS classification,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM orders""",
)
def coerced_labels(spark, sf_dir) -> DataFrame:
    """Labels forced to their allowed values."""
    kind = F.when(F.col("o_orderstatus") == "F", " fact ").otherwise("guess")
    level = F.lower(F.substring("o_orderpriority", 3, 20))
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        T.coerce(kind, W.ALLOWED_CLASSES, "INFERENCE").alias("classification"),
        T.coerce(level, W.ALLOWED_CONFIDENCE, "MEDIUM").alias("confidence"),
    )


@query(
    "scrub_ids",
    """SELECT o_orderkey AS row_id, 'Sales rose to ' || o_custkey || ' in the year.' AS text FROM orders""",
)
def scrub_ids(spark, sf_dir) -> DataFrame:
    """Prose without its internal references."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("Sales [F1 id=x:y] rose  to "), F.col("o_custkey").cast("string"),
        F.lit(" (sourceFindingIds: ["), key, F.lit("]) in chunk "), key,
        F.lit(" the\tyear chunks 4, 5 ."),
    )
    return V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"),
        F.replace(T.scrub_ids(text), F.lit("\t"), F.lit(" ")).alias("text"),
    )


@query(
    "vague_notes",
    """SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 'Debt maturity not given|gap' ELSE 'gap' END AS notes FROM orders""",
)
def vague_notes(spark, sf_dir) -> DataFrame:
    """Distinct union of notes and rejections without the vague ones."""
    notes = F.array(
        F.when(F.col("o_orderstatus") == "F", " Debt maturity not given")
        .otherwise("No material risks were identified"),
        F.lit(" "), F.lit("gap"),
    )
    merged = K.merged_notes(notes, F.array(F.lit("gap")))
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.array_join(merged, "|").alias("notes"),
    )


@query(
    "anchored_claims",
    """SELECT o_orderkey AS row_id, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_orderstatus = 'F'
      WHEN '3-MEDIUM' THEN true WHEN '4-NOT SPECIFIED' THEN o_custkey + 2000 = 3001 ELSE false END AS ok FROM orders""",
)
def anchored_claims(spark, sf_dir) -> DataFrame:
    """Claims tied to fixed excerpts: figures, basis and subtraction."""
    pri = F.col("o_orderpriority")
    a = F.col("o_custkey") + 5000
    b = F.col("o_custkey") + 2000

    def amount(c):
        return F.concat(F.lit("₹"), c.cast("string"))

    shown = F.concat(amount(a), F.lit(" and "), amount(b))
    claim = (
        F.when(pri == "1-URGENT", F.concat(F.lit("Cash was "), amount(a), F.lit(" in 2024")))
        .when(pri == "2-HIGH", F.concat(F.lit("Debt was "), amount(b)))
        .when(
            pri == "3-MEDIUM",
            F.concat(
                F.lit("Free cash of ₹3000 is "), amount(a), F.lit(" minus "),
                amount(b),
            ),
        )
        .when(
            pri == "4-NOT SPECIFIED",
            F.concat(
                F.lit("Free cash of ₹3001 is "), amount(a), F.lit(" minus "),
                amount(b),
            ),
        )
        .otherwise("No figure")
    )
    cite = F.struct(F.lit(1).alias("chunk_index"))
    rows = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"), claim.alias("claim"),
        shown.alias("data_point"),
        F.when(pri == "5-LOW", F.array().cast("array<struct<chunk_index:int>>"))
        .otherwise(F.array(cite)).alias("citations"),
        (pri == "2-HIGH").alias("financial_figure"),
        F.lit("CONSOLIDATED").alias("accounting_basis"),
        F.lit("INFERENCE").alias("classification"),
        (F.col("o_orderstatus") == "F").alias("names_group"),
        F.lit(False).alias("names_alone"),
    )
    return rows.select("row_id", K.anchored_claim_ok().alias("ok"))


JUDGE_SQL = f"""{SELECT_SQL}, flags AS (SELECT document_id, chunk_index, regexp_matches(lower(content), '\\b(consolidated|group)\\b') AS g FROM chunks),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, line_start, size) AS rn FROM packs
  WHERE section_key = 'english') WHERE rn <= 2),
claims AS (SELECT document_id, unit_id, content, chunk_index, rn, CASE rn WHEN 1 THEN content || ' revenue' ELSE 'unrelated revenue statement words entirely' END AS claim FROM one),
w0 AS (SELECT *, {_words_sql('claim')} AS w FROM claims),
w1 AS (SELECT *, list_filter(list_transform(generate_series(1, len(w)), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS u FROM w0),
h AS (SELECT *, len(list_filter(u, lambda t: contains(trim(regexp_replace(lower(content), '\\s+', ' ', 'g')), t))) AS h20,
  len(list_filter(u, lambda t: contains(lower(content), t))) AS h16 FROM w1),
s AS (SELECT *, h20 >= least(4, len(u)) AND h16 >= least(4, len(u)) AS supported FROM h)"""


@query(
    "judged_conclusions",
    f"""WITH {JUDGE_SQL} SELECT document_id, CAST(rn AS BIGINT) AS pos, CASE WHEN NOT supported THEN 'NOT_SUPPORTED'
      WHEN regexp_matches(claim, '\\d') THEN 'BASIS_NOT_ESTABLISHED' END AS reject_reason FROM s
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, 'NO_CITATION' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 4, 'SCHEMA' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 5, NULL FROM documents""",
)
def judged_conclusions(spark, sf_dir) -> DataFrame:
    """Verdict on conclusions built from each document's first units."""
    chunks = V.paragraph_chunks(spark, sf_dir)
    _, packs = _cited(spark, sf_dir)
    packs = packs.where("section_key = 'english'").withColumn(
        "section_key", F.lit("financial")
    )
    first = Window.partitionBy("company_id", "document_id").orderBy(
        "chunk_index", "line_start", "line_end"
    )
    keys = ["company_id", "document_id"]
    labels = [
        F.lit("HIGH").alias("confidence"),
        F.lit("NOT_APPLICABLE").alias("accounting_basis"),
        F.lit(False).alias("financial_figure"),
    ]
    own = packs.withColumn("pos", F.row_number().over(first)).where("pos <= 2").select(
        *keys, "section_key", F.col("pos").cast("bigint").alias("pos"),
        F.when(F.col("pos") == 1, F.concat("content", F.lit(" revenue")))
        .otherwise("unrelated revenue statement words entirely").alias("claim"),
        F.lit("INFERENCE").alias("classification"), *labels,
        F.array("unit_id").alias("evidence_ids"),
    )
    fixed = V.documents(spark, sf_dir).select(
        *keys, F.lit("financial").alias("section_key"),
        F.explode(F.sequence(F.lit(3), F.lit(5))).alias("pos"),
    ).select(
        *keys, "section_key", F.col("pos").cast("bigint").alias("pos"), F.lit("Revenue is not given.").alias("claim"),
        F.when(F.col("pos") == 3, "fact").when(F.col("pos") == 4, "opinion")
        .otherwise("uncertain").alias("classification"),
        *labels, F.array(F.lit("0:0-0")).alias("evidence_ids"),
    )
    return K.judge_conclusions(own.unionByName(fixed), packs, chunks).select(
        "document_id", "pos", "reject_reason"
    )


@query("near_duplicate_claims")
def near_duplicate_claims(spark, sf_dir) -> DataFrame:
    """Turns of each conversation without near-duplicates, users' first.

    A conversation stands for the claims of one model answer.
    """
    turns = V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("company_id"),
        F.lit("report").alias("document_id"),
        F.lit("risks").alias("section_key"), F.col("turn").alias("pos"),
        F.col("text").alias("claim"), F.lit("FACT").alias("classification"),
        "role",
    )
    anchors = turns.where("role = 'user'").drop("role")
    return K.merge_claims(anchors, turns.where("role <> 'user'").drop("role"))


# --------------------------------------------------------------------- reports


@query(
    "evidence_rows",
    f"""WITH {V.CLAIMS_SQL} SELECT finding_id, fact AS claim, 'Report, page ' || m || CASE WHEN m > 6 THEN '-' || (m + 1) ELSE '' END
      || ', chunk ' || m || '; CONSOLIDATED basis' AS supporting_source FROM claims WHERE NOT insufficient_evidence AND NOT uncited
    UNION ALL SELECT finding_id, fact, 'Report; evidence insufficient; CONSOLIDATED basis' FROM claims WHERE NOT insufficient_evidence AND uncited""",
)
def evidence_rows(spark, sf_dir) -> DataFrame:
    """Supported findings as stored evidence rows."""
    findings = V.findings(spark, sf_dir)
    documents = findings.select("company_id", "document_id").distinct().select(
        "*", F.lit("Report").alias("title"),
        F.lit(None).cast("date").alias("publication_date"),
        F.lit(None).cast("date").alias("document_date"),
    )
    return report.evidence_rows(findings, documents).select(
        "finding_id", "claim", "supporting_source"
    )


@query(
    "section_report",
    f"""WITH {V.CLAIMS_SQL}, d AS (SELECT company_id, document_id, report_section, string_agg(
        fact || CASE WHEN thin THEN '' ELSE chr(10) || 'Analysis: The order book moved because of larger single orders.'
          || chr(10) || 'Investor implication: Watch the next order intake.' END || CASE WHEN thin THEN chr(10) || 'Analysis: short' ELSE '' END
          || chr(10) || chr(10) || 'Calculations:' || chr(10) || '• Order Value: x (a, FY)'
          || chr(10) || '[Fact · high confidence · consolidated · Source: annual report]', chr(10) || chr(10) ORDER BY finding_pos) AS t
      FROM claims WHERE NOT insufficient_evidence GROUP BY 1, 2, 3)
    SELECT company_id, document_id, report_section, 'Story of the year.' || chr(10) || chr(10) || '--- Detailed findings ---'
      || chr(10) || chr(10) || t AS content FROM d""",
)
def section_report(spark, sf_dir) -> DataFrame:
    """Section text: narrative and the block of detailed findings."""
    findings = V.findings(spark, sf_dir)
    keys = ["company_id", "document_id", "report_section"]
    narratives = findings.where("NOT insufficient_evidence").select(*keys).distinct().select(
        *keys, F.lit("Story of the year.").alias("narrative"),
        F.array().cast("array<string>").alias("tables"),
    )
    return report.assemble_sections(narratives, findings)


@query(
    "section_blocks",
    """SELECT o_orderkey AS row_id, b.kind, b.text FROM orders, LATERAL (VALUES
      ('narrative', 'Intro ' || o_custkey), ('table', 'T' || o_custkey), ('narrative', 'More.'),
      ('findings', 'Finding ' || o_orderkey)) b(kind, text)""",
)
def section_blocks(spark, sf_dir) -> DataFrame:
    """Section text parsed back into its blocks."""
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    content = F.concat(
        F.lit("Intro "), cust, F.lit('\n[TABLE]{"title":"T'), cust,
        F.lit('","headers":["a"],"rows":[["1"]]}[/TABLE]\n[TABLE]{"bad":1}[/TABLE]More.\n--- Detailed findings ---\n\nFinding '),
        key,
    )
    rows = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"), content.alias("content")
    )
    return report.parse_section(rows, ["row_id"]).select(
        "row_id", "kind", F.coalesce("text", "table.title").alias("text")
    )


@query(
    "section_rollup",
    f"""WITH {V.CLAIMS_SQL}, s(report_section) AS (VALUES {", ".join(f"('{k}')" for k, t in R.REPORT_SECTIONS)}),
    f AS (SELECT company_id, document_id, CASE report_section WHEN 'F' THEN 'debt_liquidity' WHEN 'O' THEN 'inventory_analysis'
      ELSE 'elsewhere' END AS report_section FROM claims), r AS (SELECT DISTINCT company_id, document_id FROM f)
    SELECT r.company_id, r.document_id, s.report_section, count(f.report_section) AS n_findings FROM r CROSS JOIN s
    LEFT JOIN f ON f.company_id = r.company_id AND f.document_id = r.document_id AND f.report_section = s.report_section GROUP BY 1, 2, 3""",
)
def section_rollup(spark, sf_dir) -> DataFrame:
    """Every report section of every run with its number of findings."""
    kind = F.col("report_section")
    findings = V.findings(spark, sf_dir).withColumn(
        "report_section",
        F.when(kind == "F", "debt_liquidity").when(kind == "O", "inventory_analysis")
        .otherwise("elsewhere"),
    )
    return report.findings_by_section(findings, findings).select(
        "company_id", "document_id", "report_section", "n_findings"
    )


@query(
    "top3_findings",
    f"""WITH {V.CLAIMS_SQL} SELECT finding_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id, document_id, report_section
      ORDER BY finding_pos) AS rn FROM claims WHERE report_section IN ('F', 'P')) WHERE rn <= 3 AND NOT insufficient_evidence""",
)
def top3_findings(spark, sf_dir) -> DataFrame:
    """First three findings of two sections, then without insufficient ones."""
    return report.summary_seed(
        V.findings(spark, sf_dir), ["F", "P"]
    ).select("finding_id")


@query(
    "publish_gate",
    """WITH c AS (SELECT o_custkey AS company_id, CAST(month(o_orderdate) AS INTEGER) AS section_key, o_orderstatus <> 'P' AS ok FROM orders),
      s AS (SELECT company_id, section_key, count(*) FILTER (ok) AS n FROM c GROUP BY 1, 2)
    SELECT company_id, CAST(sum(n) AS BIGINT) AS supported_conclusions, count(*) FILTER (n > 0) AS complete_sections, count(*) AS n_sections,
      sum(n) >= 8 AND count(*) FILTER (n > 0) >= 5 AS publishable FROM s GROUP BY 1""",
)
def publish_gate(spark, sf_dir) -> DataFrame:
    """May a run be published?"""
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.month("o_orderdate").alias("section_key"),
        F.when(F.col("o_orderstatus") == "P", "UNCERTAIN").otherwise("FACT")
        .alias("classification"),
    )
    return report.publish_gate(rows, ["company_id"], 8, 5)


@query(
    "section_status",
    """SELECT conv_id, count(*) AS n_conclusions, count(*) FILTER (role = 'assistant') AS n_supported,
      CASE WHEN bool_or(role = 'assistant') THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS status FROM conversations GROUP BY 1""",
)
def section_status(spark, sf_dir) -> DataFrame:
    """Status per conversation: complete with one supported turn."""
    rows = V.table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.when(F.col("role") == "assistant", "FACT").otherwise("UNCERTAIN")
        .alias("classification"),
    )
    return K.section_status(rows, ["conv_id"])


@query(
    "latest_section",
    """SELECT company_id, section, research_id FROM (SELECT o_custkey AS company_id, o_orderpriority AS section, o_orderkey AS research_id,
      row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_section(spark, sf_dir) -> DataFrame:
    """Last report row per company and section."""
    research = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("section"),
        F.col("o_orderkey").alias("research_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    return report.latest_sections(research).select(
        "company_id", "section", "research_id"
    )


@query(
    "orphan_sections",
    """SELECT conv_id, turn FROM conversations WHERE role NOT IN ('user', 'assistant')""",
)
def orphan_sections(spark, sf_dir) -> DataFrame:
    """Rows whose section is in no display group."""
    groups = fixed_table(spark, ["section"], [("user",), ("assistant",)])
    rows = V.table(spark, sf_dir, "conversations").withColumnRenamed("role", "section")
    return report.orphan_sections(rows, groups).select("conv_id", "turn")


@query(
    "near_numbered",
    """SELECT conv_id, turn, conv_id || '-' || rn AS conclusion_id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations WHERE role = 'assistant') WHERE rn <= 2""",
)
def near_numbered(spark, sf_dir) -> DataFrame:
    """Accepted rows numbered per group, the first two kept."""
    rows = V.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return K.number_survivors(rows, ["conv_id"], ["turn"], 2).select(
        "conv_id", "turn", "conclusion_id"
    )


# ------------------------------------------------------------ rows-only queries


# The rule as it reads: walk the items of a company and kind by arrival, keep
# one whose keys no kept item has, and remember its keys.
KEPT_SQL = rf"""{V.HEADLINES_SQL}, keyed AS (
  SELECT company_id, item_id AS arrival, title, url, category = 'Company Update' AS news,
    url AS k1, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS k2,
    row_number() OVER (PARTITION BY company_id, category = 'Company Update' ORDER BY item_id) AS rn
  FROM headlines),
walk AS (
  SELECT company_id, news, rn, arrival, true AS kept, [k1, k2] AS seen FROM keyed WHERE rn = 1
  UNION ALL
  SELECT w.company_id, w.news, i.rn, i.arrival, NOT list_has_any(w.seen, [i.k1, i.k2]),
    CASE WHEN list_has_any(w.seen, [i.k1, i.k2]) THEN w.seen ELSE w.seen || [i.k1, i.k2] END
  FROM walk w JOIN keyed i ON i.company_id = w.company_id AND i.news = w.news AND i.rn = w.rn + 1)"""


@query(
    "two_key_dedupe",
    f"""WITH RECURSIVE {KEPT_SQL} SELECT company_id, i.arrival, title, url AS original_url, kept
    FROM keyed i JOIN walk USING (company_id, news, rn)""",
)
def two_key_dedupe(spark, sf_dir) -> DataFrame:
    """Kept and skipped items under the two-key rule."""
    return dedupe.two_key_dedupe(V.discovered_items(spark, sf_dir)).select(
        "company_id", "arrival", "title", "original_url", "kept"
    )


@query(
    "incremental_feed",
    f"""WITH RECURSIVE {KEPT_SQL} SELECT company_id, i.arrival, title, url AS original_url,
      CASE WHEN i.news THEN 'news' ELSE 'filing' END AS source_type
    FROM keyed i JOIN walk USING (company_id, news, rn) WHERE kept""",
)
def incremental_feed(spark, sf_dir) -> DataFrame:
    """Discovered items landed as three sets and taken in by three runs."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    columns = [f.split(" ")[0] for f in schemas.DISCOVERED_ITEMS.split(", ")]
    items = V.discovered_items(spark, sf_dir).withColumn(
        "arrival", F.col("arrival").cast("decimal(38,0)")
    )
    last = items.agg(F.max("arrival")).first()[0] or 0
    third = F.floor(F.col("arrival") * 3 / F.lit(int(last) + 1))
    for part in range(3):
        items.where(third == part).select(*columns).write.mode("append").parquet(
            f"{folder}/landed"
        )
        incremental.stream_items(
            spark, f"{folder}/landed", f"{folder}/items", f"{folder}/progress"
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/items").select(
        "company_id", F.col("arrival").cast("bigint").alias("arrival"),
        "source_type", "title", "original_url",
    )


@query(
    "incremental_metrics",
    f"""WITH {V.INCOMING_SQL}, {FIRSTS_SQL}
    SELECT company_id, entity_name, metric_name, reporting_period, accounting_basis, metric_value,
      CASE WHEN any_bad THEN 'CONFLICTING' ELSE 'UNVERIFIED' END AS data_quality_status
    FROM (SELECT *, bool_or(bad) OVER (PARTITION BY company_id, lower(trim(entity_name)), metric_name,
      reporting_period, accounting_basis) AS any_bad FROM gaps) WHERE rn = 1""",
)
def incremental_metrics(spark, sf_dir) -> DataFrame:
    """Incoming metrics landed as files and taken in by the stream."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = V.incoming_metrics(spark, sf_dir)
    fields = [f.split(" ", 1) for f in schemas.INCOMING_METRICS.split(", ")]
    rows.select(
        *[
            (F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n)
            for n, t in fields
        ]
    ).write.parquet(f"{folder}/landed")
    incremental.stream_metrics(
        spark, f"{folder}/landed", f"{folder}/store", f"{folder}/progress"
    ).awaitTermination()
    return incremental.current_metrics(spark, f"{folder}/store").select(
        "company_id", "entity_name", "metric_name", "reporting_period",
        "accounting_basis", "metric_value", "data_quality_status",
    )
