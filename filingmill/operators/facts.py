"""Fact extraction and the conflict-tracked metric table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.functions.rows import compute_once, explode_rows
from filingmill.rules import metrics as M
from filingmill.rules import words as W

KEY = [
    "company_id", "entity_name", "metric_name", "reporting_period",
    "accounting_basis",
]

XBRL_FACT = (
    r"<(?:[a-zA-Z0-9_]+:)?([A-Za-z][A-Za-z0-9_]*)([^>]*)>\s*([-\d,.]+)\s*"
    r"</(?:[a-zA-Z0-9_]+:)?[A-Za-z][A-Za-z0-9_]*>"
)
TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
# A label begins where its run of letters and blanks does, so that a run is
# tried once and not from each of its letters.
TEXT_FACT = r"(?<![A-Za-z /\-])([A-Za-z /\-]+?)\s{2,}+([\d,]+(?:\.\d+)?)"



def statement_type(label: Column, xbrl: bool = False) -> Column:
    """Balance sheet, cash flow or income statement, from the label."""
    balance = r"(?i)asset|liabilit|equity|borrow"
    cash = r"(?i)cash|capex"
    if xbrl:
        balance += r"|inventori|receivable|payable"
        cash += r"|capital.expend"
    return (
        F.when(label.rlike(balance), "balance_sheet")
        .when(label.rlike(cash), "cash_flow")
        .otherwise("income_statement")
    )


def _fact(
    metric: Column, value: Column, unit: Column, period: Column,
    statement: Column, origin: str, note: str,
) -> list:
    basis = F.col("accounting_basis")
    return [
        "document_id", "company_id", "entity_name",
        F.col("fact_pos").cast("bigint").alias("fact_pos"),
        metric.alias("metric_name"),
        value.alias("metric_value"),
        unit.alias("metric_unit"),
        F.lit("INR").alias("currency"),
        period.alias("reporting_period"),
        statement.alias("statement_type"),
        "accounting_basis",
        F.lit(origin).alias("extracted_from"),
        F.when(basis.isNull(), note).alias("extraction_notes"),
    ]


def xbrl_facts(documents: DataFrame) -> DataFrame:
    """XBRL text -> recognised facts; the first fact of a concept counts.

    ``documents`` has document_id, company_id, entity_name and payload.
    """
    found = F.regexp_extract_all("payload", F.lit(XBRL_FACT), 0)
    keep = ["document_id", "company_id", "entity_name", "accounting_basis"]
    rows = compute_once(
        documents, found=found,
        accounting_basis=T.detect_basis(F.col("payload")),
    )
    rows = explode_rows(rows, keep, F.col("found"), "fact", "fact_pos")
    facts = compute_once(
        rows,
        concept=F.regexp_extract("fact", XBRL_FACT, 1),
        attrs=F.regexp_extract("fact", XBRL_FACT, 2),
        value=T.leading_number(F.regexp_extract("fact", XBRL_FACT, 3)),
    ).where(F.col("value").isNotNull())
    first = Window.partitionBy("document_id", "concept").orderBy("fact_pos")
    facts = facts.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    words = F.lower(
        F.trim(F.regexp_replace("concept", "([A-Z])", " $1"))
    )
    context = F.nullif(
        F.regexp_extract("attrs", 'contextRef="([^"]+)"', 1), F.lit("")
    )
    decimals = F.coalesce(
        F.regexp_extract("attrs", r'decimals="\s*([+-]?\d+)', 1)
        .try_cast("int"),
        F.lit(0),
    )
    unit = (
        F.when(decimals <= -7, "crores_inr")
        .when(decimals <= -5, "lakhs_inr")
        .otherwise("inr")
    )
    metric = T.metric_label(words, M.METRIC_LABELS)
    return (
        compute_once(facts, metric=metric)
        .where(F.col("metric").isNotNull())
        .select(
            *_fact(
                F.col("metric"), F.col("value"), unit,
                F.coalesce(context, F.lit("UNKNOWN")),
                statement_type(F.col("concept"), xbrl=True), "XBRL",
                "Accounting basis not clear in the XBRL context; review it.",
            )
        )
    )


def clean_html(c: Column) -> Column:
    """Drop script and style blocks."""
    text = F.regexp_replace(c, r"(?is)<script.*?</script>", "")
    return F.regexp_replace(text, r"(?is)<style.*?</style>", "")


def _cell(c: Column) -> Column:
    text = F.regexp_replace(c, "<[^>]+>", "")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    return T.trim_space(F.replace(text, F.lit("&amp;"), F.lit("&")))


def html_facts(documents: DataFrame) -> DataFrame:
    """HTML tables -> facts from the first two cells of each row.

    ``documents`` also has reporting_period. Bracketed negatives are no
    numbers here and are dropped.
    """
    keep = [
        "document_id", "company_id", "entity_name", "reporting_period",
        "accounting_basis",
    ]
    rows = compute_once(
        documents,
        found=F.regexp_extract_all(
            clean_html(F.col("payload")), F.lit(TABLE_ROW), 1
        ),
        accounting_basis=T.detect_basis(F.col("payload")),
    )
    rows = explode_rows(rows, keep, F.col("found"), "row", "fact_pos")
    rows = compute_once(
        rows, cells=F.regexp_extract_all("row", F.lit(TABLE_CELL), 1)
    ).where(F.size("cells") >= 2)
    rows = compute_once(
        rows,
        label=_cell(F.get("cells", F.lit(0))),
        value=T.leading_number(_cell(F.get("cells", F.lit(1)))),
    ).where(F.col("value").isNotNull())
    return (
        compute_once(
            rows, metric=T.metric_label(F.col("label"), M.METRIC_LABELS)
        )
        .where(F.col("metric").isNotNull())
        .select(
            *_fact(
                F.col("metric"), F.col("value"), F.lit("crores_inr"),
                F.col("reporting_period"), statement_type(F.col("label")),
                "HTML", "Accounting basis not clear in the HTML; review it.",
            )
        )
    )


def guidance_statements(
    documents: DataFrame, words: Sequence[str] = W.GUIDANCE_WORDS
) -> DataFrame:
    """HTML paragraphs that read like guidance."""
    rows = compute_once(
        documents,
        found=F.regexp_extract_all(
            clean_html(F.col("payload")), F.lit(PARAGRAPH), 1
        ),
    )
    rows = explode_rows(
        rows, ["document_id", "company_id"], F.col("found"), "paragraph",
        "paragraph_pos",
    )
    text = T.trim_space(F.regexp_replace("paragraph", "<[^>]+>", ""))
    return (
        compute_once(rows, statement=text)
        .where(
            (F.length("statement") > 50)
            & F.col("statement").rlike("(?i)" + "|".join(words))
        )
        .select(
            "document_id", "company_id",
            F.col("paragraph_pos").cast("bigint").alias("paragraph_pos"),
            "statement",
            F.lit("guidance").alias("topic"),
            F.lit(False).alias("is_verbatim"),
        )
    )


def text_facts(documents: DataFrame) -> DataFrame:
    """Plain text -> facts from ``label  number`` pairs; zeros are skipped."""
    keep = [
        "document_id", "company_id", "entity_name", "reporting_period",
        "accounting_basis",
    ]
    rows = compute_once(
        documents,
        found=F.regexp_extract_all("payload", F.lit(TEXT_FACT), 0),
        accounting_basis=T.detect_basis(F.col("payload")),
    )
    rows = explode_rows(rows, keep, F.col("found"), "fact", "fact_pos")
    rows = compute_once(
        rows,
        label=F.trim(F.regexp_extract("fact", TEXT_FACT, 1)),
        value=T.leading_number(F.regexp_extract("fact", TEXT_FACT, 2)),
    )
    rows = compute_once(
        rows, metric=T.metric_label(F.col("label"), M.METRIC_LABELS)
    )
    facts = rows.where(
        F.col("metric").isNotNull() & (F.col("value") != 0)
    ).select(
        *_fact(
            F.col("metric"), F.col("value"), F.lit("crores_inr"),
            F.col("reporting_period"), statement_type(F.col("label")),
            "PDF/TEXT", "Accounting basis not clear in the text; review it.",
        )
    )
    note = F.lit("Found by text pattern; verify against the document.")
    return facts.withColumn(
        "extraction_notes", F.coalesce("extraction_notes", note)
    )


def route(content_type: Column) -> Column:
    """Extractor for a content type. XHTML goes to the XBRL extractor."""
    kind = F.lower(content_type)
    return (
        F.when(kind.contains("xml") | kind.contains("xbrl"), "xbrl")
        .when(kind.contains("html"), "html")
        .when(kind.contains("pdf"), "pdf")
        .otherwise("text")
    )


def extract_facts(documents: DataFrame) -> DataFrame:
    """Route every document to its extractor and union the facts."""
    routed = documents.withColumn("route", route(F.col("content_type")))
    return (
        xbrl_facts(routed.where("route = 'xbrl'"))
        .unionByName(html_facts(routed.where("route = 'html'")))
        .unionByName(text_facts(routed.where("route = 'text'")))
    )


def extraction_outcome(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per document: success flag, reason and counts."""
    found = facts.groupBy("document_id").agg(F.count("*").alias("n_facts"))
    kind = route(F.col("content_type"))
    n = F.coalesce("n_facts", F.lit(0))
    reason = F.when(kind == "pdf", "PARSING_FAILED").when(
        (kind == "xbrl") & (n == 0), "XBRL_UNSUPPORTED"
    )
    return documents.join(found, "document_id", "left").select(
        "document_id", "company_id", kind.alias("document_type"),
        reason.isNull().alias("ok"), reason.alias("reason"),
        n.alias("n_facts"),
        F.when(
            kind == "html",
            T.visible_text(clean_html(F.col("payload"))),
        ).when(kind == "text", F.col("payload")).alias("raw_text"),
    )


def result_metrics(periods: DataFrame) -> DataFrame:
    """Wide result periods -> long metrics; missing measures give no row."""
    wide = periods.select(
        "company_id",
        F.col("period.label").alias("reporting_period"),
        F.col("period.fiscal_year").alias("fiscal_year"),
        F.col("period.quarter").alias("quarter"),
        F.when(F.col("period.filing_type") == "annual_report", "annual")
        .otherwise("quarterly").alias("period_type"),
        "accounting_basis",
        F.col("net_sale").alias("revenue"),
        F.col("net_profit").alias("pat"),
        "other_income", "depreciation", "finance_cost",
        calc.ebitda(
            F.col("pbt"), F.col("depreciation"), F.col("finance_cost")
        ).alias("ebitda"),
        calc.ebit(
            F.col("pbt"), F.col("depreciation"), F.col("finance_cost")
        ).alias("ebit"),
        "eps",
    )
    ids = [
        "company_id", "reporting_period", "fiscal_year", "quarter",
        "period_type", "accounting_basis",
    ]
    measures = [c for c in wide.columns if c not in ids]
    return (
        wide.unpivot(ids, measures, "metric_name", "metric_value")
        .where(F.col("metric_value").isNotNull())
        .withColumns(
            {
                "metric_unit": F.when(F.col("metric_name") == "eps", "inr")
                .otherwise("lakhs_inr"),
                "currency": F.lit("INR"),
                "statement_type": F.lit("income_statement"),
            }
        )
    )


# --------------------------------------------------------- admission, conflict


def admission_reason(metric: Column, basis: Column) -> Column:
    """Why a metric cannot be stored, NULL when it can. The name goes first."""
    known = F.coalesce(metric.isin(M.METRIC_NAMES), F.lit(False))
    return F.when(~known, "INVALID_METRIC_NAME").when(
        basis.isNull(), "BASIS_UNCLEAR"
    )


def admit(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split incoming metrics into accepted rows and rejects with a reason."""
    checked = incoming.withColumn(
        "reject_reason",
        admission_reason(F.col("metric_name"), F.col("accounting_basis")),
    )
    accepted = checked.where(F.col("reject_reason").isNull())
    return (
        accepted.drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )


def _canonical(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "entity_key", F.lower(F.trim(F.col("entity_name")))
    )


CANONICAL_KEY = [
    "company_id", "entity_key", "metric_name", "reporting_period",
    "accounting_basis",
]


def first_values(accepted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per data point: the stored or first value, and its conflict flag.

    A single aggregation with map-side combine, so a data point that holds a
    third of all rows shrinks to one row per input task before the shuffle.
    The extreme later values decide the flag: the relative gap to the first
    value exceeds the limit for some later value exactly when it does for the
    smallest or the largest one.
    """
    rows = _canonical(accepted)
    kept = [c for c in accepted.columns if c not in KEY]
    if stored is not None:
        old = _canonical(stored)
        for c in ["arrival", *kept]:
            if c not in old.columns:
                kind = dict(accepted.dtypes)[c]
                old = old.withColumn(c, F.lit(None).cast(kind))
        old = old.withColumn("arrival", F.lit(-1).cast("bigint"))
        rows = rows.unionByName(old.select(*rows.columns))
    first = F.struct("entity_name", *kept)
    firsts = rows.groupBy(*CANONICAL_KEY).agg(
        F.min_by(first, F.col("arrival")).alias("first"),
        F.min("metric_value").alias("low"),
        F.max("metric_value").alias("high"),
    )
    value = F.col("first.metric_value")
    conflicting = calc.is_conflict(value, F.col("low")) | calc.is_conflict(
        value, F.col("high")
    )
    return firsts.select(
        *CANONICAL_KEY,
        F.col("first.entity_name").alias("entity_name"),
        *[F.col(f"first.{c}").alias(c) for c in kept],
        F.when(conflicting, "CONFLICTING").otherwise("UNVERIFIED")
        .alias("data_quality_status"),
    )


def store_metrics(accepted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The metric table after the incoming rows: first values with flags."""
    return first_values(accepted, stored).drop("entity_key")


def new_data_points(accepted: DataFrame, stored: DataFrame) -> DataFrame:
    """First incoming row of each data point that is not stored yet."""
    known = _canonical(stored).select(*CANONICAL_KEY).distinct()
    return (
        first_values(accepted)
        .drop("data_quality_status")
        .join(known, CANONICAL_KEY, "left_anti")
        .drop("entity_key")
    )


def metric_conflicts(
    accepted: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Data-quality rows: every later value that differs from the first one.

    Both values are kept; the preferred one (lower tier, the first on ties) is
    reported, not applied. Only data points flagged CONFLICTING are joined
    back, and adaptive execution splits a hot one on the incoming side.
    """
    firsts = (
        first_values(accepted, stored)
        .where("data_quality_status = 'CONFLICTING'")
        .select(
            *CANONICAL_KEY,
            F.col("arrival").alias("first_arrival"),
            F.col("metric_value").alias("value_a"),
            F.col("source_name").alias("source_a_name"),
            F.col("source_tier").alias("source_a_tier"),
        )
    )
    later = _canonical(accepted).join(firsts, CANONICAL_KEY)
    a, b = F.col("value_a"), F.col("metric_value")
    keep_first = F.col("source_a_tier") <= F.col("source_tier")
    return later.where(
        (F.col("arrival") > F.col("first_arrival")) & calc.is_conflict(a, b)
    ).select(
        "company_id", "entity_name", "metric_name", "reporting_period",
        "accounting_basis", "arrival",
        "value_a", "source_a_name", "source_a_tier",
        b.alias("value_b"),
        F.col("source_name").alias("source_b_name"),
        F.col("source_tier").alias("source_b_tier"),
        F.when(keep_first, a).otherwise(b).alias("preferred_value"),
        F.when(keep_first, F.col("source_a_name"))
        .otherwise(F.col("source_name")).alias("preferred_source"),
        F.lit("pending").alias("resolution_status"),
    )


def preferred_source(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source of the lowest tier per key; the first in input order on ties."""
    order = F.struct("source_tier", "arrival")
    return sources.groupBy(*keys).agg(
        F.min_by(
            F.struct("source_name", "source_tier", "arrival"), order
        ).alias("best")
    ).select(*keys, "best.source_name", "best.source_tier", "best.arrival")


def peer_comparability(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """May the metrics of a peer set be compared?

    A set is consistent in a column when its smallest and largest value agree,
    which needs no distinct count. The issue texts name what differs.
    """
    names = {
        "accounting_basis": "basis",
        "reporting_period": "period",
        "currency": "currency",
    }
    aggs = []
    for column, name in names.items():
        aggs += [
            F.min(column).alias(f"{name}_low"),
            F.max(column).alias(f"{name}_high"),
        ]
    out = metrics.groupBy(*keys).agg(F.count("*").alias("n_metrics"), *aggs)
    ok = {n: F.col(f"{n}_low") == F.col(f"{n}_high") for n in names.values()}
    issues = F.array_compact(
        F.array(
            *[
                F.when(
                    ~ok[n],
                    F.concat(
                        F.lit(f"{n}: "), F.col(f"{n}_low"), F.lit(" .. "),
                        F.col(f"{n}_high"),
                    ),
                )
                for n in names.values()
            ]
        )
    )
    return out.select(
        *keys, "n_metrics",
        ok["basis"].alias("basis_consistent"),
        ok["period"].alias("periods_consistent"),
        ok["currency"].alias("currencies_consistent"),
        (ok["basis"] & ok["period"] & ok["currency"]).alias("comparable"),
        issues.alias("issues"),
    )


# ----------------------------------------------------------------- time series


def with_previous_year(
    metrics: DataFrame, keys: Sequence[str], value: str = "metric_value"
) -> DataFrame:
    """Add the value of the year before; NULL when that year is absent."""
    by_year = Window.partitionBy(*keys).orderBy("fiscal_year")
    year_before = F.lag("fiscal_year").over(by_year)
    previous = F.when(
        year_before == F.col("fiscal_year") - 1, F.lag(value).over(by_year)
    )
    return metrics.withColumn("previous_value", previous)


def cross_checks(
    companies: DataFrame, rules: DataFrame, metrics: DataFrame
) -> DataFrame:
    """One row per rule of a company's framework and period.

    ``companies`` has company_id, framework, reporting_period and
    accounting_basis. Both values are filled in when they exist on that basis
    and period; the rules are prose, so the result stays INSUFFICIENT_DATA.
    """
    keys = ["company_id", "reporting_period", "accounting_basis"]

    def side(name: str) -> DataFrame:
        return metrics.select(
            *keys,
            F.col("metric_name").alias(f"metric_{name}"),
            F.col("metric_value").alias(f"metric_{name}_value"),
        )

    return (
        companies.join(rules, "framework")
        .join(side("a"), [*keys, "metric_a"], "left")
        .join(side("b"), [*keys, "metric_b"], "left")
        .select(
            *keys, "framework", "rule_key", "metric_a", "metric_a_value",
            "metric_b", "metric_b_value",
            F.lit("INSUFFICIENT_DATA").alias("result"),
            F.concat(
                F.lit("The evidence did not establish both "), "metric_a",
                F.lit(" and "), "metric_b",
                F.lit(" on one accounting basis."),
            ).alias("finding"),
        )
    )


def unknown_rules(stored_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored rule keys that the catalogue does not know."""
    return stored_rules.join(
        rules.select("framework", "rule_key"), ["framework", "rule_key"],
        "left_anti",
    )
