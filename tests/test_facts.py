"""Extraction and the conflict-tracked metric table."""

import random
import re
import time

from filingmill.functions import text as T
from filingmill.operators import facts
from filingmill.sources import feeds, tables
from pyspark.sql import functions as F

DOC = "document_id string, company_id string, entity_name string, reporting_period string, payload string, content_type string"


def document(spark, payload, kind="application/xml"):
    return spark.createDataFrame([("d", "c", "E", "FY24", payload, kind)], DOC)


def test_xbrl(spark):
    text = '<in:ProfitAfterTax contextRef="Q1" decimals="-7">1,234</in:ProfitAfterTax>'
    r = facts.xbrl_facts(document(spark, text)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.metric_name, r.metric_value, r.metric_unit) == ("pat", 1234, "crores_inr")
    assert (r.reporting_period, r.statement_type) == ("Q1", "income_statement")
    assert r.accounting_basis is None and r.extraction_notes is not None
    nothing = document(spark, "<EBITDA>5</EBITDA>")
    found = facts.xbrl_facts(nothing)
    assert found.count() == 0
    outcome = facts.extraction_outcome(nothing, found).collect()[0]
    assert (outcome.ok, outcome.reason) == (False, "XBRL_UNSUPPORTED")


def test_html(spark):
    text = (
        "<p>Consolidated</p><table><tr><td>Total Assets</td><td>1,200.5</td></tr>"
        "<tr><td>Net profit</td><td>(500)</td></tr></table>"
    )
    r = facts.extract_facts(document(spark, text, "text/html")).collect()
    assert [(x.metric_name, x.metric_value, x.statement_type) for x in r] == [
        ("total_assets", 1200.5, "balance_sheet")
    ]
    assert r[0].accounting_basis == "CONSOLIDATED"


def test_router(spark):
    kinds = {
        "application/xhtml+xml": "xbrl", "text/html": "html",
        "application/pdf": "pdf", "text/plain": "text",
    }
    rows = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = {r.k: r.r for r in rows.select("k", facts.route(F.col("k")).alias("r")).collect()}
    assert got == kinds


INCOMING = (
    "arrival bigint, company_id string, entity_name string, metric_name string, "
    "metric_value double, reporting_period string, accounting_basis string, "
    "source_name string, source_tier int"
)


def incoming(spark, values, **over):
    rows = [
        (i, "c", over.get("entity", "E"), "revenue", float(v), "FY24", "CONSOLIDATED", f"s{i}", 2)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, INCOMING)


def test_first_value_conflict(spark):
    rows = incoming(spark, [100, 100, 200, 100.005])
    stored = facts.store_metrics(rows).collect()
    assert [(r.metric_value, r.data_quality_status) for r in stored] == [(100, "CONFLICTING")]
    log = facts.metric_conflicts(rows).collect()
    assert [(r.value_a, r.value_b) for r in log] == [(100, 200)]


def test_stored_value_comes_first(spark):
    old = incoming(spark, [150], entity=" e ").drop("arrival")
    rows = incoming(spark, [100, 150])
    stored = facts.store_metrics(rows, old).collect()
    assert [(r.metric_value, r.data_quality_status) for r in stored] == [(150, "CONFLICTING")]
    assert [r.value_b for r in facts.metric_conflicts(rows, old).collect()] == [100]


def test_conflicts_match_a_loop(spark):
    rng = random.Random(7)
    rows, want_flags, want_log = [], {}, []
    first = {}
    for i in range(400):
        key = rng.randrange(25)
        value = rng.choice([0.0, -5.0, 5.0, 5.0004, 1000.0, 1000.05, 1001.0, -1000.0])
        rows.append((i, str(key), "E", "pat", value, "FY24", "STANDALONE", "s", rng.randrange(1, 5)))
        if key not in first:
            first[key] = value
            want_flags[key] = False
        else:
            a = first[key]
            if abs(a - value) / max(abs(a), abs(value), 1) > 0.0001:
                want_flags[key] = True
                want_log.append((i, a, value))
    frame = spark.createDataFrame(rows, INCOMING)
    got = {
        int(r.company_id): (r.metric_value, r.data_quality_status == "CONFLICTING")
        for r in facts.store_metrics(frame).collect()
    }
    assert got == {k: (first[k], want_flags[k]) for k in first}
    log = sorted((r.arrival, r.value_a, r.value_b) for r in facts.metric_conflicts(frame).collect())
    assert log == sorted(want_log)


def test_admission_tests_the_name_first(spark):
    schema = "metric_name string, accounting_basis string"
    rows = spark.createDataFrame([("revenue", None), ("foo", None), ("pat", "STANDALONE")], schema)
    accepted, rejected = facts.admit(rows)
    assert [r.metric_name for r in accepted.collect()] == ["pat"]
    assert {r.metric_name: r.reject_reason for r in rejected.collect()} == {
        "revenue": "BASIS_UNCLEAR", "foo": "INVALID_METRIC_NAME",
    }


def test_preferred_source(spark):
    rows = spark.createDataFrame(
        [("k", 0, "a", 2), ("k", 1, "b", 1), ("k", 2, "c", 1)],
        "k string, arrival int, source_name string, source_tier int",
    )
    assert facts.preferred_source(rows, ["k"]).collect()[0].source_name == "b"


def test_previous_year_must_be_adjacent(spark):
    rows = spark.createDataFrame([("k", 2020, 1.0), ("k", 2021, 2.0), ("k", 2023, 3.0)], "k string, fiscal_year int, metric_value double")
    got = {r.fiscal_year: r.previous_value for r in facts.with_previous_year(rows, ["k"]).collect()}
    assert got == {2020: None, 2021: 1.0, 2023: None}


def test_payloads(spark):
    raw = spark.createDataFrame(
        [
            ("c", 200, '"No Record Found!"'), ("c", 200, "<html>"), ("c", 200, " "),
            ("c", 500, '{"Table":[{"NEWSSUB":"Dividend"}]}'), ("c", 200, "{broken"),
            ("c", 200, '{"Table":[{"NEWSSUB":null,"HEADLINE":"Dividend Q1 FY25","NEWSID":"7","DT_TM":"","NEWS_DT":"2025-01-02T03:04:05"}]}'),
        ],
        "company_id string, http_status int, payload string",
    ).withColumn("fetched_at", F.lit("2025-02-01").cast("timestamp"))
    r = feeds.announcements(raw).collect()
    assert len(r) == 1 and r[0].title == "Dividend Q1 FY25" and r[0].quarter == "Q1FY25"
    assert str(r[0].publication_date) == "2025-01-02 03:04:05"
    assert r[0].document_url is None
    assert feeds.announcements(raw, days_back=10).count() == 0


def test_patch_and_upsert(spark):
    old = spark.createDataFrame([(1, 1, 2)], "id int, x int, y int")
    patch = spark.createDataFrame([(1, {"x": None})], "id int, patch map<string,string>")
    assert tuple(tables.sparse_patch(old, patch, "id", ["x", "y"]).collect()[0]) == (1, None, 2)
    new = spark.createDataFrame([(1, None, None), (2, 5, 6)], "id int, x int, y int")
    got = sorted(tuple(r) for r in tables.upsert(old, new, ["id"], ["y"]).collect())
    assert got == [(1, None, 2), (2, 5, 6)]


def test_registry_and_arrays(spark):
    registry = tables.source_registry(spark)
    assert registry.count() == 15
    assert registry.where("tier = 1").count() == 7
    rows = spark.createDataFrame([("default", ["a"]), ("bank", ["b"]), ("epc", None)], "k string, checks array<string>")
    copied = tables.copy_array_from(rows, "k", "default", ["bank"], "checks")
    assert {r.k: r.checks for r in copied.collect()} == {"default": ["a"], "bank": ["a"], "epc": None}
    more = tables.append_to_array(rows.where("k = 'bank'"), "checks", F.array(F.lit("c")))
    assert more.collect()[0].checks == ["b", "c"]


def test_leading_number(spark):
    rows = spark.createDataFrame([("12abc",), ("(5)",), ("-1,234.5 cr",), ("",)], "t string")
    got = [r.n for r in rows.select(T.leading_number(F.col("t")).alias("n")).collect()]
    assert got == [12.0, None, -1234.5, None]


def test_text_facts_try_a_run_of_letters_once(spark):
    plain = re.compile(r"([A-Za-z /\-]+?)\s{2,}([\d,]+(?:\.\d+)?)", re.ASCII)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB /-\n\t  12,.;") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["Net sales   1,234.5\nDebt  7", "  12", "a  ,b  3.", "x" * 20 + "  9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", F.regexp_extract_all("t", F.lit(facts.TEXT_FACT), 0).alias("m")).collect()
    want = {i: [m.group(0) for m in plain.finditer(t)] for i, t in enumerate(texts)}
    assert {r.i: r.m for r in got} == want and sum(map(len, want.values())) > 300
    start = time.time()
    long = spark.range(1).select(F.repeat(F.lit("words without a stop "), F.lit(20_000)).alias("t"))
    assert long.select(F.size(F.regexp_extract_all("t", F.lit(facts.TEXT_FACT), 0)).alias("n")).first().n == 0
    assert time.time() - start < 10


def test_news_text_is_made_once(spark):
    raw = spark.createDataFrame([], "company_id string, fetched_at timestamp, http_status int, payload string")
    plan = feeds.news_items(raw.repartition(2))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(concat_ws") == 1
