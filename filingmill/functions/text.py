"""Text scalars as Column -> Column functions.

All of them are built-in expressions, so they stay inside the JVM. The one
exception is Unicode NFKC, which Spark has no function for.

Word boundaries are written as ASCII look-arounds: Java's ``\\b`` is
Unicode-aware, and the patterns here are defined on ASCII words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filingmill.functions.rows import bind
from filingmill.rules import words as W

# White space as the source texts define it.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
YEAR = r"^(?:19|20)\d{2}$"
DAY = r"^(?:0?[1-9]|[12]\d|3[01])$"


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _word_array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def ascii_words(alternatives: str) -> str:
    """Case-insensitive pattern for whole ASCII words."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def non_space_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, rf"{SPACE}+", ""))


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    return _any([F.contains(c, F.lit(n)) for n in needles])


# ---------------------------------------------------------------- search text


def search_normalise(c: Column) -> Column:
    """Lower case; keep letters, digits, % and the rupee sign; one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}%₹]+", " "))


def ascii_normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9%₹]+", " "))


def clean_search_term(c: Column) -> Column:
    """Letters, digits and `` .&'-`` only, no wildcards."""
    kept = F.regexp_replace(trim_space(c), r"[^\p{L}\p{N} .&'-]", "")
    return F.regexp_replace(kept, r"[%_*]", "")


# ------------------------------------------------------------- numeric tokens

SIGNED_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
GROUPED_NUMBER = r"\d[\d,]*(?:\.\d+)?(?:%|[xX])?"


def _numbers(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0)
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")))


def signed_numbers(c: Column) -> Column:
    """Signed numbers with three-digit groups, nothing filtered."""
    return _numbers(c, SIGNED_NUMBER)


def material_numbers(c: Column) -> Column:
    """Signed numbers without years and without single characters."""
    return F.filter(
        signed_numbers(c), lambda t: ~t.rlike(YEAR) & (F.length(t) > 1)
    )


def grouped_numbers(c: Column) -> Column:
    """Numbers with any comma grouping; a ``%`` or ``x`` suffix stays."""
    return F.transform(_numbers(c, GROUPED_NUMBER), F.lower)


def without_years_and_days(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(YEAR) & ~t.rlike(DAY))


def missing_from(claimed: Column, source: Column) -> Column:
    """Claimed tokens absent from the source; repeats are kept."""
    return F.filter(claimed, lambda t: ~F.array_contains(source, t))


def parse_number(matched: Column) -> Column:
    """Number from a matched group with any comma grouping."""
    return F.replace(matched, F.lit(","), F.lit("")).try_cast("double")


def leading_number(c: Column) -> Column:
    """The number a text starts with, or NULL."""
    head = F.regexp_extract(
        F.replace(c, F.lit(","), F.lit("")),
        r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)",
        1,
    )
    return head.try_cast("double")


# ---------------------------------------------------------------- claim words


def meaningful_words(c: Column) -> Column:
    """Distinct words longer than three characters, no stop words."""
    pieces = F.split(
        F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "
    )
    return F.array_distinct(
        F.filter(
            pieces,
            lambda w: (F.length(w) > 3) & ~w.isin(W.CLAIM_STOP_WORDS),
        )
    )


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    )


def nfkc(c: Column) -> Column:
    """Compatibility normal form. ASCII texts have it and stay in the JVM."""
    return F.coalesce(_nfkc(F.when(F.length(c) < F.octet_length(c), c)), c)


def evidence_normalise(c: Column) -> Column:
    """Unify hyphens, quotes and white space.

    Compatibility forms are a separate step, ``nfkc``: a Python function
    cannot be part of a higher-order function, so it is its own column.
    """
    # All these characters lie outside ASCII; most texts have none.
    text = F.translate(
        c, "\u2010\u2011\u2012\u2013\u2014\u201c\u201d\u2018\u2019\u00ad", "-----\"\"''"
    )
    text = F.when(F.length(c) < F.octet_length(c), text).otherwise(c)
    return F.lower(collapse(text))


def count_contained(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def fact_grounded(
    fact: Column, data_points: Column, excerpt: Column
) -> Column:
    """Every material number and up to three long words are in the excerpt."""
    joined = F.concat_ws(" | ", F.array(fact), data_points)
    parts = F.struct(
        material_numbers(joined).alias("numbers"),
        F.filter(
            F.split(ascii_normalise(fact), " "), lambda t: F.length(t) > 3
        ).alias("words"),
        signed_numbers(excerpt).alias("shown"),
        ascii_normalise(excerpt).alias("excerpt"),
    )

    def grounded(p: Column) -> Column:
        numbers_ok = F.size(missing_from(p["numbers"], p["shown"])) == 0
        hits = count_contained(p["words"], p["excerpt"])
        return numbers_ok & (hits >= F.least(F.lit(3), F.size(p["words"])))

    return bind(parts, grounded)


def claim_supported(claim: Column, quote: Column) -> Column:
    """All numbers, and at least four of the claim words."""
    parts = F.struct(
        grouped_numbers(claim).alias("numbers"),
        meaningful_words(claim).alias("words"),
        grouped_numbers(quote).alias("shown"),
        F.lower(quote).alias("quote"),
    )

    def supported(p: Column) -> Column:
        numbers_ok = F.size(missing_from(p["numbers"], p["shown"])) == 0
        hits = count_contained(p["words"], p["quote"])
        words_ok = F.when(
            F.size(p["words"]) == 0, F.size(p["numbers"]) > 0
        ).otherwise(hits >= F.least(F.lit(4), F.size(p["words"])))
        return numbers_ok & words_ok

    return bind(parts, supported)


def subject_supported(
    claim: Column,
    excerpt: Column,
    subjects: Sequence[Sequence[str]] = W.SUBJECT_PATTERNS,
    distance: int = W.SUBJECT_DISTANCE,
) -> Column:
    """Each subject of the claim stands near each of its numbers.

    Pass an excerpt that went through ``nfkc`` where compatibility forms
    matter.
    """
    parts = F.struct(
        F.replace(evidence_normalise(excerpt), F.lit(","), F.lit(""))
        .alias("text"),
        without_years_and_days(grouped_numbers(claim)).alias("numbers"),
        claim.alias("claim"),
    )

    def one(names: Sequence[str], p: Column) -> Column:
        pattern = ascii_words("|".join(names))
        at = F.regexp_instr(p["text"], F.lit(pattern))
        near = F.forall(
            p["numbers"],
            lambda n: (F.instr(p["text"], n) > 0)
            & (F.abs(F.instr(p["text"], n) - at) <= distance),
        )
        return F.when(
            p["claim"].rlike(pattern), (at > 0) & near
        ).otherwise(True)

    return bind(
        parts,
        lambda p: reduce(
            lambda a, b: a & b, [one(s, p) for s in subjects], F.lit(True)
        ),
    )


def is_financial_figure(
    claim: Column, data_point: Column, flagged: Column
) -> Column:
    """Does the claim carry a financial figure?"""
    text = F.concat(claim, F.lit(" "), F.coalesce(data_point, F.lit("")))
    other = text.rlike(ascii_words("|".join(W.NON_FINANCIAL_WORDS)))
    override = text.rlike(ascii_words("|".join(W.FINANCIAL_OVERRIDE_WORDS)))
    money = text.rlike("₹|%") | text.rlike(
        ascii_words("|".join(W.FINANCIAL_WORDS))
    )
    return (
        F.when(other & ~override, False)
        .when(F.coalesce(flagged, F.lit(False)), True)
        .otherwise(money & text.rlike(r"\d"))
    )


def has_interpretation(
    claim: Column,
    quote: Column,
    phrases: Sequence[str] = W.INTERPRETIVE_PHRASES,
) -> Column:
    """An interpretive phrase is in the claim but not in the quote."""
    low_claim = F.lower(claim)
    low_quote = F.lower(F.coalesce(quote, F.lit("")))
    return _any(
        [
            F.contains(low_claim, F.lit(p)) & ~F.contains(low_quote, F.lit(p))
            for p in phrases
        ]
    )


# ---------------------------------------------------------- accounting basis

STANDALONE_WORDS = r"standalone|unconsolidated"
CONSOLIDATED_WORDS = r"consolidated"


def detect_basis(c: Column) -> Column:
    """STANDALONE or CONSOLIDATED when only one of them is named."""
    alone = c.rlike(ascii_words(STANDALONE_WORDS)) | c.rlike(
        r"(?i)statement of standalone|standalone financial statement"
        r"|standalone results|\(standalone\)"
    )
    group = c.rlike(ascii_words(CONSOLIDATED_WORDS)) | c.rlike(
        r"(?i)consolidated financial statement|consolidated results"
        r"|\(consolidated\)"
    )
    return (
        F.when(alone & ~group, "STANDALONE")
        .when(group & ~alone, "CONSOLIDATED")
        .otherwise(F.lit(None).cast("string"))
    )


def basis_words(c: Column) -> tuple[Column, Column]:
    """Flags: the text names a consolidated basis, a standalone basis."""
    return (
        c.rlike(ascii_words("consolidated|group")),
        c.rlike(ascii_words("standalone")),
    )


# ------------------------------------------------------- feeds and documents


def map_value(mapping: dict, key: Column) -> Column:
    """Look up a fixed table; NULL when the key is not in it."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def visible_text(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def decode_entities(c: Column) -> Column:
    """CDATA first, then ``&amp;`` first, so double escapes decode twice."""
    text = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for escaped, plain in [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "'"), ("&nbsp;", " "),
    ]:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def normalise_title(c: Column) -> Column:
    return collapse(F.lower(c))


def content_hash(url: Column, title: Column) -> Column:
    joined = F.concat(url, F.lit("::"), normalise_title(title))
    return F.substring(F.sha2(joined, 256), 1, 32)


def news_materiality(
    title: Column,
    summary: Column,
    keywords: Sequence[str] = W.NEWS_KEYWORDS,
) -> Column:
    """Score between 0 and 1 from keywords, a rupee amount and a scale."""
    return text_materiality(news_text(title, summary), keywords)


def news_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))


def text_materiality(text: Column, keywords: Sequence[str] = W.NEWS_KEYWORDS) -> Column:
    """The score of a text in lower case; it is read once per keyword."""
    hits = sum(
        (F.contains(text, F.lit(k)).cast("int") for k in keywords),
        F.lit(0),
    )
    score = F.lit(W.NEWS_BASE_SCORE) + hits * F.lit(W.NEWS_KEYWORD_SCORE)
    score = score + F.when(
        text.rlike(r"₹\s?[\d,]{4,}"), W.NEWS_RUPEE_SCORE
    ).otherwise(0.0)
    score = score + F.when(
        text.rlike(ascii_words("crore|billion|million")), W.NEWS_SCALE_SCORE
    ).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def is_material_announcement(category: Column, subject: Column) -> Column:
    by_category = contains_any(
        F.coalesce(category, F.lit("")), W.MATERIAL_CATEGORIES
    )
    return by_category | contains_any(
        F.lower(subject), W.MATERIAL_SUBJECT_WORDS
    )


def announcement_type(subject: Column, category: Column | None = None) -> Column:
    low = F.lower(subject)
    other = F.lit("") if category is None else F.lower(
        F.coalesce(category, F.lit(""))
    )
    chain = None
    for name, phrases in W.ANNOUNCEMENT_TYPES:
        hit = contains_any(low, phrases)
        if name == "credit_rating":
            hit = hit | F.contains(other, F.lit("credit rating"))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("filing")


def news_category(title: Column) -> Column:
    low = F.lower(title)
    chain = None
    for name, phrases in W.NEWS_CATEGORIES:
        hit = contains_any(low, phrases)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(W.NEWS_DEFAULT_CATEGORY)


QUARTER_IN_TITLE = r"(?i)Q([1-4])\s?FY?\s?(\d{2,4})"
YEAR_IN_TITLE = r"(?i)FY\s?(\d{2,4})[-/]?(\d{2,4})?"


def title_quarter(c: Column) -> Column:
    q = F.regexp_extract(c, QUARTER_IN_TITLE, 1)
    y = F.regexp_extract(c, QUARTER_IN_TITLE, 2)
    return F.when(
        q != "", F.concat(F.lit("Q"), q, F.lit("FY"), F.right(y, F.lit(2)))
    )


def title_year(c: Column) -> Column:
    start = F.regexp_extract(c, YEAR_IN_TITLE, 1)
    end = F.regexp_extract(c, YEAR_IN_TITLE, 2)
    tail = F.when(
        end != "", F.concat(F.lit("-"), F.right(end, F.lit(2)))
    ).otherwise("")
    return F.when(
        start != "", F.concat(F.lit("FY"), F.right(start, F.lit(2)), tail)
    )


def choose_framework(
    industry: Column, sector: Column, sub_industry: Column, words: Sequence
) -> Column:
    text = F.lower(
        F.concat_ws(
            " ",
            F.coalesce(industry, F.lit("")),
            F.coalesce(sector, F.lit("")),
            F.coalesce(sub_industry, F.lit("")),
        )
    )
    chain = None
    for name, pattern in words:
        hit = text.rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("default")


def coerce(c: Column, allowed: Sequence[str], default: str) -> Column:
    """Upper-cased value when it is allowed, else the default."""
    value = F.upper(trim_space(F.coalesce(c, F.lit(""))))
    return F.when(value.isin(list(allowed)), value).otherwise(default)


def metric_label(c: Column, labels: dict) -> Column:
    key = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    return map_value(labels, key)


def period_kind(period: Column, prefixes: dict) -> Column:
    """Quarter and filing type named by the first two letters of a period."""
    key = F.upper(F.substring(period, 1, 2))
    return F.struct(
        map_value({k: v[0] for k, v in prefixes.items()}, key)
        .alias("quarter"),
        map_value({k: v[1] for k, v in prefixes.items()}, key)
        .alias("filing_type"),
    )


# -------------------------------------------------------------------- display


def indian_digits(whole: Column) -> Column:
    """Whole number in Indian grouping, e.g. 3,71,085."""
    digits = whole.cast("string")
    head = F.length(digits) - 3
    leading = F.substring(digits, F.lit(1), head)
    grouped = F.regexp_replace(leading, r"\B(?=(\d{2})+(?!\d))", ",")
    last = F.right(digits, F.lit(3))
    return F.when(F.length(digits) <= 3, digits).otherwise(
        F.concat(grouped, F.lit(","), last)
    )


def format_measure(value: Column, unit: str | None) -> Column:
    """Display text of a computed measure."""
    none = F.lit("n/a")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if unit == "%":
        text = F.format_string("%.1f%%", value)
    elif unit == "days":
        text = F.format_string("%.1f days", value)
    elif unit == "x":
        text = F.format_string("%.2fx", value)
    else:
        whole = F.abs(F.round(value, 0 if unit == "₹cr" else 2))
        sign = F.when(value < 0, "-").otherwise("")
        grouped = indian_digits(F.floor(whole).cast("bigint"))
        if unit == "₹cr":
            text = F.concat(F.lit("₹"), sign, grouped, F.lit(" cr"))
        else:
            cents = F.regexp_replace(
                F.format_string("%.2f", whole - F.floor(whole)),
                r"^0|\.?0+$", "",
            )
            text = F.when(
                F.abs(value) >= 1, F.concat(sign, grouped, cents)
            ).otherwise(F.format_string("%.3f", value))
    return F.when(bad, none).otherwise(text)


def scrub_ids(c: Column) -> Column:
    """Remove internal references from prose."""
    text = c
    for pattern in [
        r"\s*\[F\d+[^\]]*\]",
        r"(?i)\s*\(sourceFindingIds?:[^\)]*\)",
        r"(?i)\s*(?<![A-Za-z0-9_])id\s*[:=]\s*[a-z_]+:[a-z_]+",
        r"(?i)\s*(?<![A-Za-z0-9_])chunks?\s+\d+(?:\s*,\s*\d+)*(?![A-Za-z0-9_])",
        r"(?i)\s*sourceFindingIds?\s*",
    ]:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return trim_space(F.replace(text, F.lit(" ."), F.lit(".")))


# ------------------------------------------------------------ retrieval state


def fetch_failure(status: Column, error_name: Column) -> Column:
    """Reason class of one fetch-log row; NULL when it succeeded."""
    ok = (status >= 200) & (status < 300)
    return (
        F.when(ok, F.lit(None).cast("string"))
        .when(status.isin(401, 403), "AUTH_REQUIRED")
        .when(status == 404, "NOT_FOUND")
        .when(status == 429, "RATE_LIMITED")
        .when(status.isin(301, 302), "ENDPOINT_CHANGED")
        .when(status >= 500, "SOURCE_UNREACHABLE")
        .when(status.isNull() & (error_name == "AbortError"), "SOURCE_UNREACHABLE")
        .when(
            status.isNull()
            & error_name.isin("ECONNREFUSED", "ENOTFOUND", "TypeError"),
            "NETWORK_BLOCKED",
        )
        .otherwise("UNKNOWN")
    )


def retrieval_status(reason: Column) -> Column:
    return (
        F.when(reason.isNull(), "complete")
        .when(reason.isin("NETWORK_BLOCKED", "AUTH_REQUIRED"), "blocked")
        .otherwise("failed")
    )
