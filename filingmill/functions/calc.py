"""Deterministic financial arithmetic as Column functions.

Bad input gives NULL, never an error. Every measure of two inputs takes their
accounting bases and gives NULL when they differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingmill.functions.rows import bind

NOT_APPLICABLE = "NOT_APPLICABLE"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def same_basis(*bases: Column) -> Column:
    """At most one distinct basis besides NOT_APPLICABLE."""
    named = F.filter(F.array(*bases), lambda b: b != NOT_APPLICABLE)
    return F.size(F.array_distinct(named)) <= 1


def first_basis(bases: Column) -> Column:
    named = F.filter(bases, lambda b: b != NOT_APPLICABLE)
    return F.coalesce(F.get(named, F.lit(0)), F.lit(NOT_APPLICABLE))


def yoy_percent(current: Column, previous: Column) -> Column:
    value = F.try_divide(current - previous, F.abs(previous)) * 100
    return F.when(finite(current) & finite(previous), value)


def cagr_percent(start: Column, end: Column, years: Column) -> Column:
    ratio = F.try_divide(end, start)
    good = finite(start) & finite(end) & (start > 0) & (ratio > 0) & (years > 0)
    return F.when(good, F.pow(ratio, F.try_divide(F.lit(1.0), years)) * 100 - 100)


def margin_percent(numerator: Column, denominator: Column) -> Column:
    value = F.try_divide(numerator, denominator) * 100
    return F.when(finite(denominator), value)


def margin_change(current: Column, previous: Column) -> Column:
    return current - previous


def margin_change_label(change: Column) -> Column:
    sign = F.when(change >= 0, "+").otherwise("")
    return F.concat(sign, F.format_string("%.1f pp", change))


def days_of(balance: Column, flow: Column, period_days: int = 365) -> Column:
    """Receivable, inventory or payable days."""
    return F.when(finite(flow), F.try_divide(balance, flow) * period_days)


def ratio(numerator: Column, denominator: Column, unit: str = "x") -> Column:
    value = F.try_divide(numerator, denominator)
    if unit == "%":
        value = value * 100
    return F.when(finite(denominator), value)


def free_cash_flow(operating_cash: Column, capex: Column) -> Column:
    return operating_cash - capex


def ebitda(pbt: Column, depreciation: Column, finance: Column) -> Column:
    """NULL unless all three inputs are present."""
    return pbt + depreciation + finance


def ebit(pbt: Column, depreciation: Column, finance: Column) -> Column:
    return F.when(depreciation.isNotNull(), pbt + finance)


def calculation_issues(bases: Column, values: Column, result: Column) -> Column:
    """Issue texts of one stored calculation."""
    named = F.array_distinct(F.filter(bases, lambda b: b != NOT_APPLICABLE))
    mixed = F.when(
        F.size(named) > 1,
        F.concat(
            F.lit("Mixed accounting bases: "), F.array_join(named, ", ")
        ),
    )
    bad_input = F.when(
        F.exists(values, lambda v: ~finite(v)), "Non-finite input value"
    )
    bad_result = F.when(~finite(result), "Non-finite result")
    return F.array_compact(F.array(mixed, bad_input, bad_result))


# ----------------------------------------------------------------- comparison

CONFLICT_LIMIT = 0.0001
CONTRADICTION_LIMIT = 0.05
CONTRADICTION_FLOOR = 0.0001


def relative_gap(a: Column, b: Column, floor: float) -> Column:
    base = F.greatest(F.abs(a), F.abs(b), F.lit(floor))
    return F.abs(a - b) / base


def is_conflict(a: Column, b: Column) -> Column:
    return relative_gap(a, b, 1.0) > CONFLICT_LIMIT


def is_contradiction(a: Column, b: Column) -> Column:
    return relative_gap(a, b, CONTRADICTION_FLOOR) > CONTRADICTION_LIMIT


def lookup_key(
    company: Column, entity: Column, metric: Column, period: Column,
    basis: Column,
) -> Column:
    """Canonical key of one data point."""
    return F.concat_ws(
        "::", company, F.lower(F.trim(entity)), metric, period, basis
    )


# --------------------------------------------------------------- fiscal period


MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
DATE_TEXT = r"^\s*(\d{1,2})-([A-Z]{3})-(\d{1,4})\s*$"


def exchange_date(c: Column) -> Column:
    """Date of a ``DD-MMM-YYYY`` text; days past the month roll over."""
    text = F.upper(c)
    day = F.regexp_extract(text, DATE_TEXT, 1).try_cast("int")
    name = F.regexp_extract(text, DATE_TEXT, 2)
    year = F.regexp_extract(text, DATE_TEXT, 3).try_cast("int")
    at = F.instr(F.lit(MONTHS), name)
    month = F.when((name != "") & ((at % 3) == 1), ((at + 2) / 3).cast("int"))
    year = F.when(year < 100, year + 1900).otherwise(year)
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def fiscal_period(start: Column, end: Column, result_type: Column) -> Column:
    """Label, quarter, fiscal year and filing type of a date range.

    The fiscal year ends in March. A range of eleven months or more is annual;
    so is any row of type ``A``, even a quarter.
    """
    dates = F.struct(
        exchange_date(start).alias("d1"), exchange_date(end).alias("d2")
    )
    return bind(
        dates,
        lambda d: _period_of(d["d1"], d["d2"], start, end, result_type),
    )


def _period_of(
    d1: Column, d2: Column, start: Column, end: Column, result_type: Column
) -> Column:
    month, year = F.month(d2), F.year(d2)
    fiscal_year = F.when(month <= 3, year).otherwise(year + 1)
    label_year = F.concat(
        F.lit("FY"), F.right(fiscal_year.cast("string"), F.lit(2))
    )
    quarter = (
        F.when(month == 6, 1).when(month == 9, 2)
        .when(month == 12, 3).when(month == 3, 4)
    )
    span = (year - F.year(d1)) * 12 + month - F.month(d1)
    annual = (span >= 11) | (F.coalesce(result_type, F.lit("")) == "A")
    unparsed = d1.isNull() | d2.isNull()
    raw = F.concat(F.substring(start, 1, 6), F.lit("_"), F.substring(end, 1, 6))
    label = (
        F.when(unparsed, F.concat(start, F.lit(" to "), end))
        .when(annual, label_year)
        .when(
            quarter.isNotNull(),
            F.concat(F.lit("Q"), quarter.cast("string"), label_year),
        )
        .otherwise(raw)
    )
    return F.struct(
        label.alias("label"),
        F.when(unparsed, F.lit(None).cast("int")).when(annual, 4)
        .otherwise(quarter).alias("quarter"),
        F.when(unparsed, 0).otherwise(fiscal_year).alias("fiscal_year"),
        F.when(~unparsed & annual, "annual_report")
        .otherwise("quarterly_result").alias("filing_type"),
    )


# ---------------------------------------------------------- pair compatibility


def pair_compatibility(a: str, b: str, allow_time_series: bool = False) -> Column:
    """Checks of two metric rows held in struct columns ``a`` and ``b``."""

    def both(field: str) -> tuple[Column, Column]:
        return F.col(f"{a}.{field}"), F.col(f"{b}.{field}")

    basis_a, basis_b = both("accounting_basis")
    entity_a, entity_b = both("entity_name")
    currency_a, currency_b = both("currency")
    period_a, period_b = both("reporting_period")
    basis_ok = basis_a == basis_b
    entity_ok = F.lower(F.trim(entity_a)) == F.lower(F.trim(entity_b))
    currency_ok = currency_a == currency_b
    period_ok = F.lit(True) if allow_time_series else period_a == period_b
    blocker = (
        F.when(~basis_ok, "BASIS").when(~entity_ok, "ENTITY")
        .when(~currency_ok, "CURRENCY").when(~period_ok, "PERIOD")
    )
    return F.struct(
        basis_ok.alias("basis_ok"),
        entity_ok.alias("entity_ok"),
        currency_ok.alias("currency_ok"),
        period_ok.alias("period_ok"),
        (basis_ok & entity_ok & currency_ok & period_ok).alias("compatible"),
        blocker.alias("primary_blocker"),
    )
