"""Hand-worked cases of the scalar functions."""

import math

from pyspark.sql import functions as F

from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.operators import facts
from filingmill.rules import metrics as M
from filingmill.rules import research as R


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    return row.collect()[0]


def number(x):
    return F.lit(x).cast("double")


def test_growth(spark):
    r = one(
        spark,
        a=calc.yoy_percent(number(110), number(100)),
        b=calc.yoy_percent(number(50), number(-100)),
        c=calc.yoy_percent(number(5), number(0)),
        d=calc.cagr_percent(number(100), number(121), number(2)),
        e=calc.cagr_percent(number(0), number(121), number(2)),
        f=calc.cagr_percent(number(100), number(-5), number(2)),
        g=calc.days_of(number(100), number(730)),
        h=calc.days_of(number(100), number(0)),
        i=calc.margin_change_label(number(0)),
    )
    assert (r.a, r.b, r.c) == (10, 150, None)
    assert abs(r.d - 10) < 1e-9 and r.e is None and r.f is None
    assert (r.g, r.h, r.i) == (50, None, "+0.0 pp")


def test_verify_calculation(spark):
    r = one(
        spark,
        issues=calc.calculation_issues(
            F.array(F.lit("CONSOLIDATED"), F.lit("STANDALONE")),
            F.array(number(1), number(2)), number(math.nan),
        ),
    )
    assert r.issues == [
        "Mixed accounting bases: CONSOLIDATED, STANDALONE",
        "Non-finite result",
    ]


def test_ebitda_needs_all_inputs(spark):
    none = F.lit(None).cast("double")
    r = one(
        spark,
        a=calc.ebitda(number(10), number(3), none),
        b=calc.ebit(number(10), number(3), none),
        c=calc.ebitda(number(10), number(3), number(2)),
        d=calc.ebit(number(10), number(3), number(2)),
        e=calc.ebit(number(10), none, number(2)),
    )
    assert tuple(r) == (None, None, 15, 12, None)


def test_fiscal_period(spark):
    def p(a, b, t):
        return calc.fiscal_period(F.lit(a), F.lit(b), F.lit(t))

    r = one(
        spark,
        a=p("01-OCT-2024", "31-DEC-2024", "U"),
        b=p("01-APR-2024", "31-MAR-2025", "U"),
        c=p("01-JUL-2024", "30-SEP-2024", "A"),
        d=p("bad", "31-MAR-2025", "U"),
        e=p("01-May-2024", "31-May-2024", None),
    )
    assert tuple(r.a) == ("Q3FY25", 3, 2025, "quarterly_result")
    assert tuple(r.b) == ("FY25", 4, 2025, "annual_report")
    assert tuple(r.c) == ("FY25", 4, 2025, "annual_report")
    assert tuple(r.d) == ("bad to 31-MAR-2025", None, 0, "quarterly_result")
    assert r.e.label == "01-May_31-May" and r.e.quarter is None


def test_conflict_gap(spark):
    r = one(
        spark,
        a=calc.is_conflict(number(1000), number(1000.05)),
        b=calc.is_conflict(number(1000), number(1001)),
        c=calc.is_conflict(number(0.5), number(0.50005)),
        d=calc.is_contradiction(number(100), number(106)),
        e=calc.is_contradiction(number(100), number(105)),
    )
    assert tuple(r) == (False, True, False, True, False)


def test_number_tokens(spark):
    text = F.lit("₹3,71,085 crore in FY2025-26")
    r = one(
        spark, a=T.material_numbers(text), b=T.signed_numbers(text),
        c=T.grouped_numbers(text), d=T.grouped_numbers(F.lit("up 5.5% or 2X")),
    )
    assert r.a == ["71085", "-26"]
    assert r.b == ["3", "71085", "2025", "-26"]
    assert r.c == ["371085", "2025", "26"]
    assert r.d == ["5.5%", "2x"]


def test_basis(spark):
    cases = {
        "Standalone results": "STANDALONE",
        "unconsolidated": "STANDALONE",
        "unconsolidated financial statement": None,
        "standalone and consolidated": None,
        "": None,
        "Group (Consolidated)": "CONSOLIDATED",
    }
    for text, basis in cases.items():
        assert one(spark, x=T.detect_basis(F.lit(text))).x == basis, text


def test_labels_and_frameworks(spark):
    labels = {
        "Shareholders' Equity": "net_worth",
        "Non-controlling interest": None,
        "Net  Profit": None,
        " Net Profit ": "pat",
    }
    for label, name in labels.items():
        got = one(spark, x=T.metric_label(F.lit(label), M.METRIC_LABELS)).x
        assert got == name, label
    frameworks = {
        "Housing Finance": "bank", "Auto parts": "manufacturing",
        "Diversified holding": "conglomerate", "Retail": "default",
    }
    none = F.lit(None).cast("string")
    for industry, name in frameworks.items():
        got = one(
            spark,
            x=T.choose_framework(F.lit(industry), none, none, R.FRAMEWORK_WORDS),
        ).x
        assert got == name, industry


def test_feed_scalars(spark):
    none = F.lit(None).cast("string")
    r = one(
        spark,
        a=T.decode_entities(F.lit("&amp;lt;b&amp;gt;")),
        b=T.news_materiality(F.lit("Company reports"), none),
        c=T.news_materiality(
            F.lit("Board approves dividend of ₹5,000 crore"), none
        ),
        d=T.announcement_type(F.lit("Earnings call transcript")),
        e=T.announcement_type(F.lit("Credit rating reaffirmed")),
        f=T.announcement_type(F.lit("Board meeting")),
        g=T.news_category(F.lit("Merger rating results")),
        h=T.title_quarter(F.lit("Results Q1 FY2027")),
        i=T.title_year(F.lit("Results Q1 FY2027")),
        j=T.title_year(F.lit("Annual report FY2025-26")),
        k=T.title_quarter(F.lit("Annual report FY2025-26")),
    )
    assert r.a == "<b>"
    assert round(r.b, 6) == 0.1 and round(r.c, 6) == 0.42
    assert (r.d, r.e, r.f) == ("concall", "credit_rating", "filing")
    assert r.g == "M&A"
    assert (r.h, r.i, r.j, r.k) == ("Q1FY27", "FY27", "FY25-26", None)


def test_display(spark):
    r = one(
        spark,
        a=T.indian_digits(F.lit(371085)),
        b=T.indian_digits(F.lit(12345678)),
        c=T.indian_digits(F.lit(999)),
        d=T.format_measure(number(17.84), "%"),
        e=T.format_measure(number(50), "days"),
        f=T.format_measure(number(1.239), "x"),
        g=T.format_measure(number(95754.4), "₹cr"),
        h=T.format_measure(number(1234.5), None),
        i=T.format_measure(number(0.12345), None),
        j=T.format_measure(number(math.inf), "%"),
        k=T.format_measure(number(-1234), None),
    )
    assert (r.a, r.b, r.c) == ("3,71,085", "1,23,45,678", "999")
    assert (r.d, r.e, r.f) == ("17.8%", "50.0 days", "1.24x")
    assert (r.g, r.h, r.i) == ("₹95,754 cr", "1,234.5", "0.123")
    assert (r.j, r.k) == ("n/a", "-1,234")


def test_scrub(spark):
    text = "Sales rose [F1 id=a:b] (sourceFindingIds: [x]) in chunks 4, 5 to id: a_b:c ."
    assert one(spark, x=T.scrub_ids(F.lit(text))).x == "Sales rose in to."


def test_normalisation(spark):
    rows = spark.createDataFrame([("ﬁne­print  “A” – x",)], "t string")
    got = rows.select(T.nfkc(F.col("t")).alias("t")).select(
        T.evidence_normalise(F.col("t")).alias("t")
    )
    assert got.collect()[0].t == 'fineprint "a" - x'


def test_statement_type(spark):
    r = one(
        spark, a=facts.statement_type(F.lit("Trade Receivables")),
        b=facts.statement_type(F.lit("TradeReceivables"), xbrl=True),
        c=facts.statement_type(F.lit("Capex")),
    )
    assert tuple(r) == ("income_statement", "balance_sheet", "cash_flow")


def test_evidence_normalise_of_plain_and_other_texts(spark):
    """Only texts beyond ASCII are translated, with the same result."""
    listed = ["A ‐‑‒–— b", "“q” ‘s’", "so­ft  Été", "Plain  'text' - \"x\"", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(listed)], "i int, t string")
    out = rows.select("i", T.evidence_normalise(F.col("t")).alias("n"))
    assert [r.n for r in out.orderBy("i").collect()] == ["a ----- b", "\"q\" 's'", "soft été", "plain 'text' - \"x\"", "", None]
    assert "octet_length" in out._jdf.queryExecution().optimizedPlan().toString()
