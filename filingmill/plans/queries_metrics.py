"""Queries on metrics, calculators, conflicts and comparability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.operators import facts, views
from filingmill.plans.catalog import query
from filingmill.rules import metrics as M
from filingmill.rules import research as R
from filingmill.session import fixed_table
from filingmill.sources import feeds, tables
from filingmill.sources import testviews as V


def _r(c):
    return F.round(c, 6)


@query(
    "yoy_margin",
    f"""WITH {V.YEARLY_SQL}, m AS (
      SELECT *, CASE WHEN revenue <> 0 THEN pat / revenue * 100 END AS margin,
        lag(fiscal_year) OVER w AS py, lag(revenue) OVER w AS pr,
        lag(CASE WHEN revenue <> 0 THEN pat / revenue * 100 END) OVER w AS pm
      FROM yearly WINDOW w AS (PARTITION BY entity_name, accounting_basis ORDER BY fiscal_year))
    SELECT entity_name, accounting_basis, fiscal_year, revenue,
      CASE WHEN py = fiscal_year - 1 THEN pr END AS previous_revenue,
      round(CASE WHEN py = fiscal_year - 1 AND pr <> 0 THEN (revenue - pr) / abs(pr) * 100 END, 6) AS yoy_pct,
      round(margin, 6) AS margin_pct,
      round(CASE WHEN py = fiscal_year - 1 THEN margin - pm END, 6) AS margin_change_pp
    FROM m""",
)
def yoy_margin(spark, sf_dir) -> DataFrame:
    """Growth and margin per entity, basis and year."""
    keys = ["entity_name", "accounting_basis"]
    yearly = V.yearly_metrics(spark, sf_dir).withColumn(
        "margin", calc.margin_percent(F.col("pat"), F.col("revenue"))
    )
    rows = facts.with_previous_year(yearly, keys, "revenue").withColumnRenamed(
        "previous_value", "previous_revenue"
    )
    rows = facts.with_previous_year(rows, keys, "margin")
    return rows.select(
        *keys, "fiscal_year", "revenue", "previous_revenue",
        _r(calc.yoy_percent(F.col("revenue"), F.col("previous_revenue")))
        .alias("yoy_pct"),
        _r(F.col("margin")).alias("margin_pct"),
        _r(calc.margin_change(F.col("margin"), F.col("previous_value")))
        .alias("margin_change_pp"),
    )


@query(
    "cagr",
    f"""WITH {V.YEARLY_SQL}, e AS (
      SELECT entity_name, accounting_basis, min(fiscal_year) AS y1, max(fiscal_year) AS y2,
        arg_min(revenue, fiscal_year) AS r1, arg_max(revenue, fiscal_year) AS r2
      FROM yearly GROUP BY 1, 2)
    SELECT entity_name, accounting_basis, y2 - y1 AS years,
      round(CASE WHEN r1 > 0 AND r2 / r1 > 0 AND y2 > y1
        THEN pow(r2 / r1, 1.0 / (y2 - y1)) * 100 - 100 END, 6) AS cagr_pct FROM e""",
)
def cagr(spark, sf_dir) -> DataFrame:
    """Compound growth from the first to the last year of each entity."""
    y = F.col("fiscal_year")
    ends = V.yearly_metrics(spark, sf_dir).groupBy(
        "entity_name", "accounting_basis"
    ).agg(
        (F.max(y) - F.min(y)).alias("years"),
        F.min_by("revenue", y).alias("r1"), F.max_by("revenue", y).alias("r2"),
    )
    value = calc.cagr_percent(
        F.col("r1"), F.col("r2"), F.col("years").cast("double")
    )
    return ends.select(
        "entity_name", "accounting_basis", "years", _r(value).alias("cagr_pct")
    )


@query(
    "days_ratio",
    f"""WITH {V.YEARLY_SQL}
    SELECT entity_name, accounting_basis, fiscal_year,
      round(CASE WHEN revenue <> 0 THEN receivables / revenue * 365 END, 6) AS receivable_days,
      round(CASE WHEN revenue <> 0 THEN receivables / revenue END, 6) AS turnover_x,
      round(CASE WHEN revenue <> 0 THEN receivables / revenue * 100 END, 6) AS turnover_pct,
      round(pat - receivables, 4) AS free_cash
    FROM yearly""",
)
def days_ratio(spark, sf_dir) -> DataFrame:
    """Days, ratios and the cash difference per entity and year."""
    a, b = F.col("receivables"), F.col("revenue")
    return V.yearly_metrics(spark, sf_dir).select(
        "entity_name", "accounting_basis", "fiscal_year",
        _r(calc.days_of(a, b)).alias("receivable_days"),
        _r(calc.ratio(a, b)).alias("turnover_x"),
        _r(calc.ratio(a, b, "%")).alias("turnover_pct"),
        F.round(calc.free_cash_flow(F.col("pat"), a), 4).alias("free_cash"),
    )


@query(
    "ebitda_guard",
    """SELECT o_orderkey AS filing_id, v.metric_name, v.metric_value FROM orders, LATERAL (
      SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS pbt,
        CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(month(o_orderdate) AS DOUBLE) END AS dep,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(day(o_orderdate) AS DOUBLE) END AS fin) x,
      LATERAL (VALUES ('ebitda', pbt + dep + fin), ('ebit', CASE WHEN dep IS NOT NULL THEN pbt + fin END),
        ('depreciation', dep), ('finance_cost', fin)) v(metric_name, metric_value)
    WHERE v.metric_value IS NOT NULL""",
)
def ebitda_guard(spark, sf_dir) -> DataFrame:
    """EBITDA and EBIT exist only when all three inputs do; wide to long."""
    pri = F.col("o_orderpriority")
    pbt, dep, fin = F.col("pbt"), F.col("depreciation"), F.col("finance_cost")
    wide = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("filing_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("pbt"),
        F.when(pri != "5-LOW", F.month("o_orderdate").cast("double"))
        .alias("depreciation"),
        F.when(pri != "1-URGENT", F.dayofmonth("o_orderdate").cast("double"))
        .alias("finance_cost"),
    ).withColumns(
        {"ebitda": calc.ebitda(pbt, dep, fin), "ebit": calc.ebit(pbt, dep, fin)}
    )
    measures = ["ebitda", "ebit", "depreciation", "finance_cost"]
    return wide.unpivot(
        "filing_id", measures, "metric_name", "metric_value"
    ).where("metric_value IS NOT NULL")


_MONTH = "substring('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST({m} AS INT) * 3 - 2, 3)"


def _date_text(year: str, month: str, day: str) -> str:
    return (
        f"lpad(CAST({day} AS STRING), 2, '0') || '-' || {_MONTH.format(m=month)}"
        f" || '-' || CAST({year} AS STRING)"
    )


@query(
    "fiscal_period",
    """WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
        o_orderstatus AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 'A' ELSE 'U' END AS t FROM orders),
      d AS (SELECT *, CASE s WHEN 'O' THEN 3 ELSE m END AS em,
        CASE s WHEN 'O' THEN y + 1 ELSE y END AS ey, CASE s WHEN 'O' THEN 4 ELSE m END AS sm FROM p),
      f AS (SELECT *, CASE WHEN em <= 3 THEN ey ELSE ey + 1 END AS fy,
        CASE em WHEN 6 THEN 1 WHEN 9 THEN 2 WHEN 12 THEN 3 WHEN 3 THEN 4 END AS q,
        (s = 'O' OR t = 'A') AS annual FROM d)
    SELECT o_orderkey AS filing_id,
      CASE WHEN annual THEN 'FY' || right(CAST(fy AS VARCHAR), 2)
        WHEN q IS NOT NULL THEN 'Q' || CAST(q AS VARCHAR) || 'FY' || right(CAST(fy AS VARCHAR), 2)
        ELSE '01-' || substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', sm * 3 - 2, 3) || '_' ||
             '28-' || substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', em * 3 - 2, 3) END AS label,
      CAST(CASE WHEN annual THEN 4 ELSE q END AS INTEGER) AS quarter, CAST(fy AS INTEGER) AS fiscal_year,
      CASE WHEN annual THEN 'annual_report' ELSE 'quarterly_result' END AS filing_type FROM f""",
)
def fiscal_period(spark, sf_dir) -> DataFrame:
    """Period label of a date range given as exchange text."""
    y, m = "year(o_orderdate)", "month(o_orderdate)"
    start = f"CASE o_orderstatus WHEN 'O' THEN {_date_text(y, '4', '1')} ELSE {_date_text(y, m, '1')} END"
    end = f"CASE o_orderstatus WHEN 'O' THEN {_date_text(y + ' + 1', '3', '31')} ELSE {_date_text(y, m, '28')} END"
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "A").otherwise("U")
    return V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("filing_id"),
        calc.fiscal_period(F.expr(start), F.expr(end), kind).alias("p"),
    ).select("filing_id", "p.*")


FIRSTS_SQL = """
ok AS (SELECT * FROM incoming WHERE metric_name IN ('revenue', 'receivables') AND accounting_basis IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY company_id, lower(trim(entity_name)), metric_name,
  reporting_period, accounting_basis ORDER BY arrival) AS rn,
  first_value(metric_value) OVER w AS fv, first_value(source_name) OVER w AS fs,
  first_value(source_tier) OVER w AS ft FROM ok
  WINDOW w AS (PARTITION BY company_id, lower(trim(entity_name)), metric_name, reporting_period,
    accounting_basis ORDER BY arrival)),
gaps AS (SELECT *, abs(fv - metric_value) / greatest(abs(fv), abs(metric_value), 1) > 0.0001 AS bad FROM firsts)"""


@query(
    "metric_conflicts",
    f"""WITH {V.INCOMING_SQL}, {FIRSTS_SQL},
    flags AS (SELECT *, bool_or(bad) OVER (PARTITION BY company_id, lower(trim(entity_name)), metric_name,
      reporting_period, accounting_basis) AS any_bad FROM gaps)
    SELECT company_id, entity_name, metric_name, reporting_period, accounting_basis, arrival,
      metric_value, source_name, source_tier,
      CASE WHEN any_bad THEN 'CONFLICTING' ELSE 'UNVERIFIED' END AS data_quality_status
    FROM flags WHERE rn = 1""",
)
def metric_conflicts(spark, sf_dir) -> DataFrame:
    """The metric table: first value per data point, with conflict flag."""
    accepted, _ = facts.admit(V.incoming_metrics(spark, sf_dir))
    return facts.store_metrics(accepted.drop("currency"))


@query(
    "conflict_log",
    f"""WITH {V.INCOMING_SQL}, {FIRSTS_SQL}
    SELECT company_id, entity_name, metric_name, reporting_period, accounting_basis, arrival,
      fv AS value_a, fs AS source_a_name, ft AS source_a_tier,
      metric_value AS value_b, source_name AS source_b_name, source_tier AS source_b_tier,
      CASE WHEN ft <= source_tier THEN fv ELSE metric_value END AS preferred_value,
      CASE WHEN ft <= source_tier THEN fs ELSE source_name END AS preferred_source,
      'pending' AS resolution_status
    FROM gaps WHERE rn > 1 AND bad""",
)
def conflict_log(spark, sf_dir) -> DataFrame:
    """Every later value that differs from the stored first one."""
    accepted, _ = facts.admit(V.incoming_metrics(spark, sf_dir))
    return facts.metric_conflicts(accepted)


@query(
    "metric_admission",
    f"""WITH {V.INCOMING_SQL}
    SELECT arrival, metric_name, accounting_basis,
      CASE WHEN metric_name NOT IN ('revenue', 'receivables') THEN 'INVALID_METRIC_NAME'
        ELSE 'BASIS_UNCLEAR' END AS reject_reason
    FROM incoming WHERE metric_name NOT IN ('revenue', 'receivables') OR accounting_basis IS NULL""",
)
def metric_admission(spark, sf_dir) -> DataFrame:
    """Rejected metrics with their reason."""
    _, rejected = facts.admit(V.incoming_metrics(spark, sf_dir))
    return rejected.select(
        "arrival", "metric_name", "accounting_basis", "reject_reason"
    )


@query(
    "pair_compat",
    f"""WITH {V.INCOMING_SQL}, p AS (SELECT *, first_value(accounting_basis) OVER w AS b_basis,
      first_value(currency) OVER w AS b_currency, first_value(reporting_period) OVER w AS b_period,
      first_value(entity_name) OVER w AS b_entity
      FROM incoming WHERE accounting_basis IS NOT NULL
      WINDOW w AS (PARTITION BY metric_name, source_name ORDER BY arrival, accounting_basis))
    SELECT arrival, accounting_basis, accounting_basis = b_basis AS basis_ok, lower(entity_name) = lower(b_entity) AS entity_ok,
      currency = b_currency AS currency_ok, reporting_period = b_period AS period_ok,
      accounting_basis = b_basis AND entity_name = b_entity AND currency = b_currency
        AND reporting_period = b_period AS compatible,
      CASE WHEN accounting_basis <> b_basis THEN 'BASIS' WHEN entity_name <> b_entity THEN 'ENTITY'
        WHEN currency <> b_currency THEN 'CURRENCY' WHEN reporting_period <> b_period THEN 'PERIOD'
      END AS primary_blocker FROM p""",
)
def pair_compat(spark, sf_dir) -> DataFrame:
    """May a figure be used together with the first one of its source?"""
    keys = ["metric_name", "source_name"]
    fields = F.struct(
        "accounting_basis", "entity_name", "currency", "reporting_period"
    )
    rows = V.incoming_metrics(spark, sf_dir).where(
        "accounting_basis IS NOT NULL"
    ).withColumn("a", fields)
    order = F.struct("arrival", "accounting_basis")
    firsts = rows.groupBy(*keys).agg(F.min_by("a", order).alias("b"))
    return rows.join(firsts, keys).select(
        "arrival", "accounting_basis", calc.pair_compatibility("a", "b").alias("c")
    ).select("arrival", "accounting_basis", "c.*")


@query(
    "peer_compat",
    f"""WITH {V.INCOMING_SQL}
    SELECT metric_name, source_name, count(*) AS n_metrics,
      count(DISTINCT accounting_basis) <= 1 AS basis_consistent,
      count(DISTINCT reporting_period) <= 1 AS periods_consistent,
      count(DISTINCT currency) <= 1 AS currencies_consistent,
      count(DISTINCT accounting_basis) <= 1 AND count(DISTINCT reporting_period) <= 1
        AND count(DISTINCT currency) <= 1 AS comparable,
      concat_ws('; ', CASE WHEN count(DISTINCT accounting_basis) > 1
          THEN 'basis: ' || min(accounting_basis) || ' .. ' || max(accounting_basis) END,
        CASE WHEN count(DISTINCT reporting_period) > 1
          THEN 'period: ' || min(reporting_period) || ' .. ' || max(reporting_period) END,
        CASE WHEN count(DISTINCT currency) > 1
          THEN 'currency: ' || min(currency) || ' .. ' || max(currency) END) AS issues
    FROM incoming WHERE accounting_basis IS NOT NULL GROUP BY 1, 2""",
)
def peer_compat(spark, sf_dir) -> DataFrame:
    """Comparability of the peers behind each metric and source."""
    rows = V.incoming_metrics(spark, sf_dir).where("accounting_basis IS NOT NULL")
    out = facts.peer_comparability(rows, ["metric_name", "source_name"])
    return out.withColumn("issues", F.array_join("issues", "; "))


@query(
    "preferred_source",
    f"""WITH {V.INCOMING_SQL}
    SELECT company_id, metric_name, reporting_period, source_name, source_tier, arrival FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id, metric_name, reporting_period
        ORDER BY source_tier, arrival) AS rn FROM incoming) WHERE rn = 1""",
)
def preferred_source(spark, sf_dir) -> DataFrame:
    """Most trusted source per data point."""
    keys = ["company_id", "metric_name", "reporting_period"]
    return facts.preferred_source(V.incoming_metrics(spark, sf_dir), keys)


_RULES = ", ".join(
    f"('{f}', '{r}', '{a}', '{b}')" for f, r, a, b in R.CROSS_CHECK_RULES
)


@query(
    "cross_check_rows",
    f"""WITH {V.YEARLY_SQL}, rules(framework, rule_key, metric_a, metric_b) AS (VALUES {_RULES}),
    firms AS (SELECT n_name AS company_id, CASE n_regionkey WHEN 0 THEN 'bank' WHEN 1 THEN 'epc'
      WHEN 2 THEN 'conglomerate' ELSE 'default' END AS framework FROM nation),
    base AS (SELECT DISTINCT entity_name AS company_id, CAST(fiscal_year AS VARCHAR) AS reporting_period,
      accounting_basis FROM yearly),
    long AS (SELECT entity_name AS company_id, CAST(fiscal_year AS VARCHAR) AS reporting_period,
      accounting_basis, unnest(['revenue', 'pat', 'receivables']) AS metric_name,
      unnest([revenue, pat, receivables]) AS metric_value FROM yearly)
    SELECT b.company_id, b.reporting_period, b.accounting_basis, f.framework, r.rule_key,
      r.metric_a, a.metric_value AS metric_a_value, r.metric_b, c.metric_value AS metric_b_value,
      'INSUFFICIENT_DATA' AS result,
      'The evidence did not establish both ' || r.metric_a || ' and ' || r.metric_b
        || ' on one accounting basis.' AS finding
    FROM base b JOIN firms f USING (company_id) JOIN rules r USING (framework)
    LEFT JOIN long a ON a.company_id = b.company_id AND a.reporting_period = b.reporting_period
      AND a.accounting_basis = b.accounting_basis AND a.metric_name = r.metric_a
    LEFT JOIN long c ON c.company_id = b.company_id AND c.reporting_period = b.reporting_period
      AND c.accounting_basis = b.accounting_basis AND c.metric_name = r.metric_b""",
)
def cross_check_rows(spark, sf_dir) -> DataFrame:
    """One row per rule of each company's framework, year and basis."""
    yearly = V.yearly_metrics(spark, sf_dir).select(
        F.col("entity_name").alias("company_id"),
        F.col("fiscal_year").cast("string").alias("reporting_period"),
        "accounting_basis", "revenue", "pat", "receivables",
    )
    keys = ["company_id", "reporting_period", "accounting_basis"]
    long = yearly.unpivot(
        keys, ["revenue", "pat", "receivables"], "metric_name", "metric_value"
    )
    region = F.col("n_regionkey")
    firms = V.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("company_id"),
        F.when(region == 0, "bank").when(region == 1, "epc")
        .when(region == 2, "conglomerate").otherwise("default")
        .alias("framework"),
    )
    rules = fixed_table(
        spark, ["framework", "rule_key", "metric_a", "metric_b"],
        R.CROSS_CHECK_RULES,
    )
    return facts.cross_checks(
        yearly.select(*keys).join(firms, "company_id"), rules, long
    )


@query(
    "metric_list",
    f"""WITH {V.INCOMING_SQL}
    SELECT metric_name, metric_value, currency, reporting_period, accounting_basis, source_name
    FROM incoming WHERE company_id = '7' AND accounting_basis = 'CONSOLIDATED'
    ORDER BY reporting_period DESC, metric_name, arrival LIMIT 200""",
)
def metric_list(spark, sf_dir) -> DataFrame:
    """The 200 latest consolidated figures of one company."""
    columns = [
        "metric_name", "metric_value", "currency", "reporting_period",
        "accounting_basis", "source_name",
    ]
    return tables.scan(
        V.incoming_metrics(spark, sf_dir),
        columns,
        {"company_id": "7", "accounting_basis": "CONSOLIDATED"},
        [F.desc("reporting_period"), F.col("metric_name"), F.col("arrival")],
        views.METRIC_LIMIT,
    )


@query(
    "lookup_keys",
    f"""WITH {V.INCOMING_SQL}
    SELECT company_id || '::' || lower(trim(entity_name)) || '::' || metric_name || '::'
      || reporting_period || '::' || accounting_basis AS lookup_key, count(*) AS n_rows,
      min(metric_value) AS low, max(metric_value) AS high
    FROM incoming WHERE accounting_basis IS NOT NULL GROUP BY 1""",
)
def lookup_keys(spark, sf_dir) -> DataFrame:
    """Rows and value range per canonical data-point key."""
    key = calc.lookup_key(
        F.col("company_id"), F.col("entity_name"), F.col("metric_name"),
        F.col("reporting_period"), F.col("accounting_basis"),
    )
    return (
        V.incoming_metrics(spark, sf_dir)
        .where("accounting_basis IS NOT NULL")
        .groupBy(key.alias("lookup_key"))
        .agg(
            F.count("*").alias("n_rows"),
            F.min("metric_value").alias("low"),
            F.max("metric_value").alias("high"),
        )
    )


@query(
    "verify_calculations",
    """SELECT o_orderkey AS filing_id, concat_ws('; ',
      CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'
        THEN 'Mixed accounting bases: CONSOLIDATED, STANDALONE' END,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'Non-finite input value' END,
      CASE WHEN o_orderpriority = '5-LOW' OR month(o_orderdate) = 1 THEN 'Non-finite result' END) AS issues
    FROM orders""",
)
def verify_calculations(spark, sf_dir) -> DataFrame:
    """Issues of a stored calculation: mixed bases, non-finite numbers."""
    pri = F.col("o_orderpriority")
    second = F.when(pri == "1-URGENT", "NOT_APPLICABLE").when(
        F.col("o_orderstatus") == "F", "STANDALONE"
    ).otherwise("CONSOLIDATED")
    value = F.when(pri == "5-LOW", float("nan")).otherwise(F.col("o_totalprice"))
    result = F.when(F.month("o_orderdate") == 1, float("inf")).otherwise(value)
    issues = calc.calculation_issues(
        F.array(F.lit("CONSOLIDATED"), second),
        F.array(value, F.lit(1.0)), result,
    )
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("filing_id"),
        F.array_join(issues, "; ").alias("issues"),
    )


_LABELS = {
    "STANDARD": ("Net Profit", "pat"),
    "ECONOMY": ("Shareholders' Equity", "net_worth"),
    "SMALL": ("Non-controlling interest", None),
    "MEDIUM": ("Net  Profit", None),
    "LARGE": ("Trade Receivables", "receivables"),
    "PROMO": ("Capex", "capex"),
}


def _case(column: str, pairs: dict, i: int) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v[i])}" for k, v in pairs.items())
    return f"CASE {column} {whens} END"


@query(
    "label_map",
    f"""SELECT p_partkey AS row_id, {_case('p_type', _LABELS, 0)} AS label,
      {_case('p_type', _LABELS, 1)} AS metric_name,
      CASE p_type WHEN 'ECONOMY' THEN 'balance_sheet' WHEN 'PROMO' THEN 'cash_flow'
        ELSE 'income_statement' END AS statement_type,
      CASE p_type WHEN 'ECONOMY' THEN 'balance_sheet' WHEN 'LARGE' THEN 'balance_sheet'
        WHEN 'PROMO' THEN 'cash_flow' ELSE 'income_statement' END AS xbrl_statement_type
    FROM part""",
)
def label_map(spark, sf_dir) -> DataFrame:
    """Filing label -> metric name and statement."""
    label = T.map_value({k: v[0] for k, v in _LABELS.items()}, F.col("p_type"))
    return V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), label.alias("label")
    ).select(
        "row_id", "label",
        T.metric_label(F.col("label"), M.METRIC_LABELS).alias("metric_name"),
        facts.statement_type(F.col("label")).alias("statement_type"),
        facts.statement_type(F.col("label"), xbrl=True)
        .alias("xbrl_statement_type"),
    )


_XBRL = """'<x><in:ProfitAfterTax contextRef="Q' || CAST(quarter(o_orderdate) AS STRING)
  || '" decimals="-7">' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
  || '</in:ProfitAfterTax><in:ProfitAfterTax>5</in:ProfitAfterTax><EBITDA>7</EBITDA>'
  || '<in:TradeReceivables decimals="-5">' || CAST(o_custkey AS STRING)
  || '</in:TradeReceivables>' || CASE o_orderstatus WHEN 'F' THEN '<b>Consolidated</b>'
  ELSE '' END || '</x>'"""


@query(
    "xbrl_facts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, m.metric_name, m.metric_value, m.metric_unit,
      m.reporting_period, m.statement_type,
      CASE WHEN o_orderstatus = 'F' THEN 'CONSOLIDATED' END AS accounting_basis
    FROM orders, LATERAL (VALUES
      ('pat', CAST(floor(o_totalprice) AS DOUBLE), 'crores_inr', 'Q' || CAST(quarter(o_orderdate) AS VARCHAR), 'income_statement'),
      ('receivables', CAST(o_custkey AS DOUBLE), 'lakhs_inr', 'UNKNOWN', 'balance_sheet'))
      m(metric_name, metric_value, metric_unit, reporting_period, statement_type)""",
)
def xbrl_facts(spark, sf_dir) -> DataFrame:
    """Facts of one XBRL text per order."""
    documents = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_custkey").cast("string").alias("company_id"),
        F.lit("E").alias("entity_name"), F.expr(_XBRL).alias("payload"),
    )
    return facts.xbrl_facts(documents).select(
        "document_id", "metric_name", "metric_value", "metric_unit",
        "reporting_period", "statement_type", "accounting_basis",
    )


_HTML = """'<p>Standalone results</p><script>var a = "<tr><td>Net profit</td><td>1</td></tr>"</script>'
  || '<table><tr><th>Total&nbsp;Assets</th><td>' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
  || '.5</td><td>9</td></tr><TR><td><b>Net profit</b></td><td>(500)</td></TR><tr><td>Turnover</td><td>'
  || CAST(o_custkey AS STRING) || ' cr</td></tr><tr><td>Borrowings</td></tr></table>'"""


@query(
    "html_facts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, m.metric_name, m.metric_value, m.statement_type,
      'STANDALONE' AS accounting_basis
    FROM orders, LATERAL (VALUES ('total_assets', floor(o_totalprice) + 0.5, 'balance_sheet'),
      ('revenue', CAST(o_custkey AS DOUBLE), 'income_statement')) m(metric_name, metric_value, statement_type)""",
)
def html_facts(spark, sf_dir) -> DataFrame:
    """Facts of one HTML table per order."""
    documents = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_custkey").cast("string").alias("company_id"),
        F.lit("E").alias("entity_name"), F.lit("FY24").alias("reporting_period"),
        F.expr(_HTML).alias("payload"),
    )
    return facts.html_facts(documents).select(
        "document_id", "metric_name", "metric_value", "statement_type",
        "accounting_basis",
    )


_PLAIN = """'Report of the year. Net profit   ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
  || ', Trade payables     ' || CAST(o_custkey AS STRING) || '  Cash   0  Unknown label   7'"""


@query(
    "text_facts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, m.metric_name, m.metric_value
    FROM orders, LATERAL (VALUES ('pat', floor(o_totalprice)), ('payables', CAST(o_custkey AS DOUBLE)))
      m(metric_name, metric_value) WHERE m.metric_value <> 0""",
)
def text_facts(spark, sf_dir) -> DataFrame:
    """Facts of one plain text per order."""
    documents = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_custkey").cast("string").alias("company_id"),
        F.lit("E").alias("entity_name"), F.lit("FY24").alias("reporting_period"),
        F.expr(_PLAIN).alias("payload"),
    )
    return facts.text_facts(documents).select(
        "document_id", "metric_name", "metric_value"
    )


@query(
    "result_metrics",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_totalprice AS net, month(o_orderdate) AS dep,
        year(o_orderdate) AS y FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS company_id, 'Q1FY' || right(CAST(y + 1 AS VARCHAR), 2) AS reporting_period,
      CAST(y + 1 AS INTEGER) AS fiscal_year, CASE WHEN s = 'F' THEN 'CONSOLIDATED' END AS accounting_basis,
      v.metric_name, v.metric_value,
      CASE WHEN v.metric_name = 'eps' THEN 'inr' ELSE 'lakhs_inr' END AS metric_unit
    FROM r, LATERAL (VALUES ('revenue', CAST(floor(net) AS DOUBLE)),
      ('depreciation', CASE WHEN s <> 'P' THEN CAST(dep AS DOUBLE) END), ('finance_cost', 2.0),
      ('ebitda', CASE WHEN s <> 'P' THEN 10.0 + dep + 2 END), ('ebit', CASE WHEN s <> 'P' THEN 12.0 END),
      ('eps', 1.5)) v(metric_name, metric_value) WHERE v.metric_value IS NOT NULL""",
)
def result_metrics(spark, sf_dir) -> DataFrame:
    """Results payload as JSON text -> long metrics."""
    year = F.year("o_orderdate").cast("string")
    item = F.struct(
        F.concat(F.lit("01-APR-"), year).alias("re_from_dt"),
        F.concat(F.lit("30-JUN-"), year).alias("re_to_dt"),
        F.lit("U").alias("re_res_type"),
        F.regexp_replace(
            F.floor("o_totalprice").cast("bigint").cast("string"),
            r"(\d+)(\d{3})$", "$1,$2",
        ).alias("re_net_sale"),
        F.lit("10").alias("re_pro_loss_bef_tax"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(
            F.month("o_orderdate").cast("string")
        ).alias("re_depr_und_exp"),
        F.lit("2").alias("re_int_new"),
        F.lit("-").alias("re_basic_eps"),
        F.lit("1.5").alias("re_basic_eps_for_cont_dic_opr"),
        F.when(F.col("o_orderstatus") == "F", "Consolidated results")
        .otherwise("Notes").alias("re_desc_note_fin"),
    )
    raw = V.keyed_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("company_id"),
        F.lit(200).alias("http_status"),
        F.to_json(F.struct(F.array(item).alias("resCmpData"))).alias("payload"),
    )
    return facts.result_metrics(feeds.result_periods(raw)).select(
        "company_id", "reporting_period", "fiscal_year", "accounting_basis",
        "metric_name", "metric_value", "metric_unit",
    )
