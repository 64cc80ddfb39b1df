"""Framework catalogues, stored rows and the smaller operators."""

from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.operators import conclusions as K
from filingmill.operators import report, retrieve, views
from filingmill.rules import metrics as M
from filingmill.rules import research as R
from filingmill.session import fixed_table
from filingmill.sources import tables


def test_catalogue_sizes():
    assert len(R.SECTIONS) == len(R.SECTION_QUERIES) == len(R.SECTION_SCOPE) == 22
    assert sum(len(q) for q in R.SECTION_QUERIES.values()) == 163
    assert len(R.CROSS_CHECK_RULES) == 28 and len(R.RESEARCH_CHECKS) == 23
    assert sum(len(m) for m in R.KEY_METRICS.values()) == 56
    assert len(M.METRIC_NAMES) == 24 and len(R.REPORT_SECTIONS) == 27


def test_query_table(spark):
    rows = retrieve.section_queries(spark)
    assert rows.count() == 163
    assert rows.where("section_key = 'governance' AND query_index = 0").collect()[0].query == "independent auditor's report"


def test_frameworks(spark):
    frameworks = spark.createDataFrame(
        [("bank", [("business", "Business", "d1", True), ("governance", "Gov", "d2", False)], [("k1", "auditor"), ("k2", "long_term")])],
        "industry_type string, analysis_sections array<struct<section_key:string,section_label:string,description:string,required:boolean>>, "
        "research_checks array<struct<check_key:string,category:string>>",
    )
    assert [r.section_key for r in report.required_sections(frameworks).collect()] == ["business"]
    assert [r.check_key for r in report.checks_in_category(frameworks, "auditor").collect()] == ["k1"]
    sections = spark.createDataFrame([("segments",), ("governance",)], "section_key string")
    links = report.section_framework(sections, frameworks).collect()
    assert sorted((r.section_key, r.framework_section) for r in links) == [("governance", "governance"), ("segments", "business")]
    checks = fixed_table(spark, ["check_key", "category"], R.RESEARCH_CHECKS)
    governance = report.section_checks(sections, checks).where("section_key = 'governance'")
    assert governance.count() == 7


def test_section_checks_of_a_frequent_key(spark):
    """Pairs of one key take many tasks, and none is lost or made twice."""
    sections = spark.range(3000, numPartitions=1).select(
        F.expr("nullif(id DIV 2, 7)").alias("order"), F.lit("industry").alias("section_key"), F.lit(1).alias("size")
    )
    checks = spark.range(2500, numPartitions=1).select(
        F.col("id").alias("check"), F.expr("nullif(id % 5, 0)").alias("weight"), F.lit("long_term").alias("category"), F.lit(1).alias("size")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = report.section_checks(sections, checks, ["size"])
        assert sorted(rows.columns) == ["category", "check", "order", "section_key", "size", "weight"]
        tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 3000 * 2500 and max(tasks) <= sum(tasks) // 2
        twice = rows.groupBy("order", "check", "weight").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
        assert tuple(twice) == (2, 2, 1500 * 2500)
        assert rows.where("order IS NULL").count() == 2 * 2500 and rows.where("weight IS NULL").count() == 3000 * 500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_section_checks_hold_one_section_at_once(spark):
    """The lists of a pair of blocks become rows in two generated stages, not in one."""
    sections = spark.range(40).select(F.col("id").alias("order"), F.lit("industry").alias("section_key"))
    checks = spark.range(30).select(F.col("id").alias("check"), F.lit("long_term").alias("category"))
    rows = report.section_checks(sections, checks)
    assert rows.count() == rows.distinct().count() == 40 * 30
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(_listed") < plan.index("Coalesce") < plan.index("Generate explode(_own")


def test_period_kind(spark):
    rows = spark.createDataFrame([("H1FY25",), ("FY25",), ("X",)], "p string")
    got = [tuple(r.k) for r in rows.select(T.period_kind(F.col("p"), M.PERIOD_PREFIXES).alias("k")).collect()]
    assert got == [(2, "half_yearly_result"), (4, "annual_report"), (None, None)]


def test_stored_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [("c", None, "u", "t", "x" * 100_005)],
        "company_id string, document_url string, source_url string, title string, content string",
    )
    a, b = (tables.stored_documents(rows).collect()[0] for _ in range(2))
    assert len(a.content) == 100_005 and a.document_id == b.document_id
    cut = tables.stored_documents(rows, content_limit=100_000).first()
    assert len(cut.content) == 100_000
    statements = spark.createDataFrame([("y" * 10_001,)], "statement string")
    assert len(tables.stored_statements(statements).first().statement) == 10_001
    assert len(tables.stored_statements(statements, 10_000).first().statement) == 10_000

    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    tables.append(old, path, ["k"])
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert tables.replace_scope_checked(spark, new, path, ["k"], staging) == 1
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 9), ("b", 3)]


def test_conclusion_rows(spark):
    schema = (
        "company_id string, document_id string, section_key string, claim string, classification string, "
        "confidence string, financial_figure boolean, accounting_basis string, data_point string"
    )
    section = spark.createDataFrame([("c", "d", "risks", "R", "INFERENCE", "LOW", True, "STANDALONE", "x")], schema)
    summary = spark.createDataFrame([("c", "d", "quick_view", "Q", "FACT", "HIGH", False, "NOT_CLEAR", "y")], schema)
    got = {r.report_section: (r.data_point, r.ai_interpretation) for r in report.conclusion_rows(section, summary).collect()}
    assert got == {"risks": ("[STANDALONE] x", "R"), "quick_view": ("y", None)}


def test_anchor_chunks(spark):
    schema = "company_id string, document_id string, section_key string, chunk_index int"
    chunks = spark.createDataFrame([("c", "d", "industry", 3), ("c", "d", "risks", 3)], schema)
    anchors = spark.createDataFrame([("d", "industry", 44)], "document_id string, section_key string, chunk_index int")
    got = sorted((r.section_key, r.chunk_index) for r in retrieve.add_anchor_chunks(chunks, anchors).collect())
    assert got == [("industry", 3), ("industry", 44), ("risks", 3)]


def test_grouped_sections(spark):
    groups = fixed_table(spark, ["label", "section"], [("G", "a"), ("H", "b")])
    rows = spark.createDataFrame([("a", "text"), ("b", "  "), ("z", "text")], "section string, content string")
    assert [r.label for r in report.grouped_sections(rows, groups).collect()] == ["G"]
    assert [r.section for r in report.orphan_sections(rows, groups).collect()] == ["z"]


def test_row_checks_pass_unknown(spark):
    rows = spark.createDataFrame([(5, None), (None, 2)], "source_tier int, quarter int")
    checked = views.row_checks(rows, views.table_checks("financial_metrics")).collect()
    assert [r.violations for r in checked] == [["tier"], []]


def test_named_views(spark):
    rows = spark.createDataFrame([("CONFLICTING", False, "pending"), ("VERIFIED", True, "resolved")], "data_quality_status string, is_processed boolean, resolution_status string")
    assert views.quality_watch(rows).count() == views.unread_news(rows).count() == views.open_conflicts(rows).count() == 1


def test_scopes(spark):
    cases = [("subsidiaries", "The JV began", True), ("subsidiaries", "jvx", False), ("financial", "PAT rose", True), ("financial", "pattern", False), ("risks", "Disputes", True)]
    rows = spark.createDataFrame(cases, "s string, c string, want boolean")
    for r in rows.select("*", K.in_scope(F.col("s"), F.col("c")).alias("got")).collect():
        assert r.got == r.want, r


def test_emptied_scopes(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    tables.replace_scope(frame([("a", 1), ("b/ :", 2), ("c", 3), (None, 4)]), path, ["k"])
    tables.replace_scope(frame([("a", 9)]), path, ["k"], frame([("a", 0), ("b/ :", 0), (None, 0), ("gone", 0)]))
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("c", 3)]
    count = tables.replace_scope_checked(
        spark, frame([]), path, ["k"], str(tmp_path / "s"), frame([("c", 0)])
    )
    assert count == 0 and [r.k for r in spark.read.parquet(path).collect()] == ["a"]


def test_documents_without_chunks_lose_theirs(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "document_id string, chunk_index int"
    rows = [(f"d{i}", j) for i in range(6) for j in range(2)]
    tables.write_chunks(spark.createDataFrame(rows, schema), path, buckets=2)
    tables.write_chunks(
        spark.createDataFrame([("d0", 7)], schema), path, buckets=2,
        documents=spark.createDataFrame([("d0",), ("d1",), ("d2",)], "document_id string"),
    )
    got = sorted((r.document_id, r.chunk_index) for r in spark.read.parquet(path).collect())
    assert got == [("d0", 7), *[(f"d{i}", j) for i in (3, 4, 5) for j in range(2)]]


def test_sections_do_not_vanish(spark):
    schema = "company_id string, document_id string, section_key string, classification string"
    accepted = spark.createDataFrame([("c", "d", "financial", "FACT"), ("c", "d", "risk", "UNCERTAIN")], schema)
    asked = spark.createDataFrame([("c", "d", s, "") for s in ("financial", "risk", "debt")], schema)
    status = K.section_status(accepted, sections=asked)
    got = {r.section_key: (r.n_conclusions, r.n_supported, r.status) for r in status.collect()}
    assert got == {"financial": (1, 1, "COMPLETE"), "risk": (1, 0, "INSUFFICIENT"), "debt": (0, 0, "INSUFFICIENT")}
    rows = K.uncertain_rows(status).collect()
    assert [(r.section_key, r.classification) for r in rows] == [("debt", "UNCERTAIN")]
