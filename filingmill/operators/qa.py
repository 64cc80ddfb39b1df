"""Checks of findings against the evidence they cite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.rules import words as W

RUN = ["company_id", "document_id"]
MIN_QUOTE = 40
MIN_ANALYSIS = 40
MIN_IMPLICATION = 20


def _note(status: str, detail: Column, severity: str) -> Column:
    return F.struct(
        F.lit(status).alias("status"), detail.alias("detail"),
        F.lit(severity).alias("severity"),
    )


def grounding_note() -> Column:
    """Every claimed number must be in the supporting quote."""
    joined = F.concat_ws(" | ", F.array("fact"), F.col("data_points"))
    missing = T.missing_from(
        T.material_numbers(joined),
        T.material_numbers(F.col("supporting_quote")),
    )
    detail = F.concat(
        F.lit("Numbers not found in cited evidence: "),
        F.array_join(missing, ", "),
    )
    quote = F.coalesce("supporting_quote", F.lit(""))
    return (
        F.when(F.col("insufficient_evidence"), None)
        .when(
            quote == "",
            _note(
                "MISSING_EVIDENCE",
                F.lit("No supporting quote captured for this finding."),
                "HIGH",
            ),
        )
        .when(F.size(missing) > 0, _note("NUMERICAL_MISMATCH", detail, "HIGH"))
    )


def basis_note() -> Column:
    """The first calculation that mixes accounting bases."""

    def bases(c: Column) -> Column:
        return F.array_distinct(
            F.filter(c["inputs"]["basis"], lambda b: b != calc.NOT_APPLICABLE)
        )

    mixed = F.filter("calculations", lambda c: F.size(bases(c)) > 1)
    first = F.get(mixed, F.lit(0))
    detail = F.concat(
        F.lit('Calculation "'), first["metric"], F.lit('" mixes bases: '),
        F.array_join(bases(first), ", "),
    )
    return F.when(F.size(mixed) > 0, _note("BASIS_MIXED", detail, "HIGH"))


def calculation_note() -> Column:
    """The first calculation that fails its own verification."""

    def issues(c: Column) -> Column:
        return calc.calculation_issues(
            c["inputs"]["basis"], c["inputs"]["value"], c["result"]
        )

    bad = F.filter("calculations", lambda c: F.size(issues(c)) > 0)
    first = F.get(bad, F.lit(0))
    detail = F.concat(
        F.lit('Calculation "'), first["metric"], F.lit('" — '),
        F.array_join(issues(first), "; "),
    )
    return F.when(
        F.size(bad) > 0, _note("NUMERICAL_MISMATCH", detail, "MEDIUM")
    )


def support_note() -> Column:
    """A finding needs a citation and some analysis or implication."""
    thin = (
        F.length(T.trim_space(F.coalesce("analysis", F.lit(""))))
        < MIN_ANALYSIS
    ) & (
        F.length(T.trim_space(F.coalesce("investor_implication", F.lit(""))))
        < MIN_IMPLICATION
    )
    return (
        F.when(F.col("insufficient_evidence"), None)
        .when(
            F.coalesce(F.size("citations"), F.lit(0)) <= 0,
            _note(
                "UNSUPPORTED_CONCLUSION", F.lit("Finding has no citations."),
                "HIGH",
            ),
        )
        .when(
            thin,
            _note(
                "UNSUPPORTED_CONCLUSION",
                F.lit("Analysis and implication are effectively empty."),
                "MEDIUM",
            ),
        )
    )


def finding_notes(findings: DataFrame) -> DataFrame:
    """Notes of the row-level checks, one row each; no shuffle."""
    notes = F.array_compact(
        F.array(
            grounding_note(), basis_note(), calculation_note(), support_note()
        )
    )
    return findings.select(
        *RUN, "finding_id", F.explode(notes).alias("note")
    ).select(*RUN, "finding_id", "note.*")


# ------------------------------------------------------------- contradictions


def finding_results(findings: DataFrame) -> DataFrame:
    """One row per calculation result, in finding order."""
    c = F.col("c")
    return findings.select(
        *RUN, "finding_id", "finding_pos",
        F.posexplode("calculations").alias("calc_pos", "c"),
    ).select(
        *RUN, "finding_id", "finding_pos", "calc_pos",
        F.lower(c["metric"]).alias("metric"),
        calc.first_basis(c["inputs"]["basis"]).alias("basis"),
        c["period"].alias("period"),
        c["result"].alias("value"),
    )


def contradictory_groups(
    results: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Groups holding two results more than five percent apart.

    The widest pair of a group is its smallest and largest value, so one
    aggregation with map-side combine decides, and no pairs are built.
    """
    low, high = F.col("low"), F.col("high")
    return (
        results.groupBy(*keys)
        .agg(
            F.count("*").alias("n_results"),
            F.min(value).alias("low"), F.max(value).alias("high"),
        )
        .where(F.col("n_results") > 1)
        .withColumn(
            "gap", calc.relative_gap(low, high, calc.CONTRADICTION_FLOOR)
        )
        .where(F.col("gap") > calc.CONTRADICTION_LIMIT)
    )


def contradicted_results(
    results: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str = "value",
) -> DataFrame:
    """Results that a later result of the same group contradicts.

    A result has such a partner exactly when the smallest or the largest later
    value is too far off, so each row needs two suffix extremes and no pairs.
    They are found in blocks of positions: first over the blocks of a group,
    then inside each block. A group of n rows is cut into about sqrt(n)
    blocks, so no task sorts more than about sqrt(n) of its rows at a time.
    ``position`` is a whole number, unique in its group.
    """
    keys = list(keys)
    pos = F.col(position)
    spans = results.groupBy(*keys).agg(
        F.min(pos).alias("_from"), F.max(pos).alias("_to"),
        F.count("*").alias("_n"),
    )
    width = F.ceil(
        (F.col("_to") - F.col("_from") + 1) / F.ceil(F.sqrt(F.col("_n")))
    )
    blocked = (
        results.join(spans, keys)
        .where(F.col("_n") > 1)
        .withColumn("_block", F.floor((pos - F.col("_from")) / width))
        .select(*results.columns, "_block")
    )
    following = (
        Window.partitionBy(*keys).orderBy("_block")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    blocks = (
        blocked.groupBy(*keys, "_block")
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        .select(
            *keys, "_block",
            F.min("_low").over(following).alias("_next_low"),
            F.max("_high").over(following).alias("_next_high"),
        )
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(position)
        .rowsBetween(1, Window.unboundedFollowing)
    )
    rows = (
        blocked.withColumns(
            {
                "_in_low": F.min(value).over(inside),
                "_in_high": F.max(value).over(inside),
            }
        )
        .join(blocks, [*keys, "_block"])
        .withColumns(
            {
                "later_low": F.least("_in_low", "_next_low"),
                "later_high": F.greatest("_in_high", "_next_high"),
            }
        )
    )
    v = F.col(value)
    far = calc.is_contradiction(v, F.col("later_low")) | calc.is_contradiction(
        v, F.col("later_high")
    )
    return rows.where(F.coalesce(far, F.lit(False))).select(
        *results.columns, "later_low", "later_high"
    )


def contradiction_notes(findings: DataFrame) -> DataFrame:
    """One MEDIUM note per result that a later finding contradicts."""
    keys = [*RUN, "metric", "basis", "period"]
    rows = contradicted_results(
        finding_results(findings).withColumn(
            "order", F.col("finding_pos") * 1000 + F.col("calc_pos")
        ),
        keys, "order",
    )
    low, high = F.col("later_low"), F.col("later_high")
    v = F.col("value")
    farthest = F.when(
        calc.relative_gap(v, low, calc.CONTRADICTION_FLOOR)
        >= calc.relative_gap(v, high, calc.CONTRADICTION_FLOOR), low,
    ).otherwise(high)
    return rows.select(
        *RUN, "finding_id",
        F.lit("CONTRADICTS_OTHER_FINDING").alias("status"),
        F.format_string(
            "Same metric (%s) produced different results: %.2f vs %.2f",
            F.col("period"), v, farthest,
        ).alias("detail"),
        F.lit("MEDIUM").alias("severity"),
    )


# -------------------------------------------------------------------- summary


def qa_summary(
    findings: DataFrame, notes: DataFrame, missing: DataFrame | None = None
) -> DataFrame:
    """Totals per run: findings, passed, failed, notes, missing questions."""
    totals = findings.groupBy(*RUN).agg(F.count("*").alias("total_findings"))
    failed = notes.groupBy(*RUN).agg(
        F.count("*").alias("n_notes"),
        F.count_distinct(
            F.when(F.col("severity") == "HIGH", F.col("finding_id"))
        ).alias("failed"),
    )
    out = totals.join(failed, RUN, "left").na.fill(0, ["n_notes", "failed"])
    out = out.withColumn("passed", F.col("total_findings") - F.col("failed"))
    if missing is None:
        return out
    questions = missing.groupBy(*RUN).agg(
        F.array_sort(
            F.collect_set(F.concat_ws(":", "specialist", "question_id"))
        ).alias("missing_questions")
    )
    return out.join(questions, RUN, "left")


def run_totals(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings, supported and insufficient ones per group."""
    return findings.groupBy(*keys).agg(
        F.count("*").alias("n_findings"),
        F.count_if(~F.col("insufficient_evidence")).alias("n_supported"),
        F.count_if("insufficient_evidence").alias("n_insufficient"),
    )


def known_answers(raw: DataFrame, questions: DataFrame) -> DataFrame:
    """Findings whose question was asked; the rest is dropped."""
    return raw.join(questions, ["specialist", "question_id"], "left_semi")


def missing_questions(
    findings: DataFrame, questions: DataFrame, keys: Sequence[str] = ("specialist", "question_id")
) -> DataFrame:
    """Asked questions without a supported finding."""
    answered = findings.where(~F.col("insufficient_evidence"))
    return questions.join(answered.select(*keys), list(keys), "left_anti")


# ------------------------------------------------------------------ citations


def cited_units(cited: DataFrame, packs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolve cited evidence ids to units.

    ``cited`` has the key columns, the document, a section per pack and
    ``evidence_ids``. An id is a unit id, or else its first number is a chunk
    of the pack and stands for all units of that chunk.
    """
    pack = ["company_id", "document_id", "section_key"]
    ids = cited.select(
        *keys, *[c for c in pack if c not in keys],
        F.posexplode("evidence_ids").alias("cite_pos", "raw_id"),
    ).withColumn("raw_id", T.trim_space(F.col("raw_id")))
    units = packs.select(
        *pack, "unit_id", "chunk_index", "page_start", "page_end",
        "line_start", "content",
    )
    exact = ids.join(
        units.withColumn("raw_id", F.col("unit_id")), [*pack, "raw_id"]
    )
    known = units.select(*pack, F.col("unit_id").alias("raw_id"))
    chunk = F.regexp_extract("raw_id", r"(\d+)", 1).try_cast("int")
    by_chunk = (
        ids.join(known, [*pack, "raw_id"], "left_anti")
        .withColumn("chunk_index", chunk)
        .where(F.col("chunk_index").isNotNull())
        .join(units, [*pack, "chunk_index"])
    )
    out = [
        *keys, *[c for c in pack if c not in keys], "cite_pos", "unit_id",
        "chunk_index", "page_start", "page_end", "line_start", "content",
    ]
    return exact.select(*out).unionByName(by_chunk.select(*out))


def exact_units(cited: DataFrame, packs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cited units by exact id only; unknown ids are dropped."""
    pack = ["company_id", "document_id", "section_key"]
    ids = cited.select(
        *keys, *[c for c in pack if c not in keys],
        F.posexplode("evidence_ids").alias("cite_pos", "unit_id"),
    ).withColumn("unit_id", T.trim_space(F.col("unit_id")))
    return ids.join(packs, [*pack, "unit_id"])


def citations(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct citations per key, by chunk, with the excerpt cited."""
    per_unit = units.groupBy(*keys, "chunk_index", "unit_id").agg(
        F.min("cite_pos").alias("cite_pos"),
        F.min("line_start").alias("line_start"),
        F.max_by(
            F.struct("page_start", "page_end", "content"), F.col("cite_pos")
        ).alias("u"),
    )
    cite = F.struct(
        "chunk_index",
        F.col("u.page_start").alias("page_start"),
        F.col("u.page_end").alias("page_end"),
        F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"))
        .alias("chunk_label"),
    )
    part = F.struct("cite_pos", "chunk_index", "line_start", "u.content")
    return per_unit.groupBy(*keys).agg(
        F.array_sort(F.collect_set(cite)).alias("citations"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(part)), lambda p: p["content"]
            ),
            " \n ",
        ).alias("excerpt"),
    )


def quote_fallback(
    findings: DataFrame, packs: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Units containing an uncited quote, first per pack.

    ``findings`` has the key columns, the document and supporting_quote.
    Instead of testing every quote on every unit of its document, both sides
    meet on a word the needle must hold whole: the longest of its inner words
    (the first and the last may be cut). Only then is the text compared.
    Quotes without an inner word meet all units of their document.
    """
    pack = ["company_id", "document_id", "section_key"]
    doc = ["company_id", "document_id"]
    needle = F.lower("supporting_quote")
    inner = F.regexp_extract_all(
        "needle", F.lit(r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"), 0
    )
    longest = F.array_max(
        F.transform(
            inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))
        )
    )["w"]
    asked = (
        findings.where(F.length(T.trim_space(F.col("supporting_quote"))) > MIN_QUOTE)
        .select(*keys, *[c for c in doc if c not in keys], needle.alias("needle"))
        .withColumn("word", longest)
    )
    place = [*pack, "unit_id", "chunk_index", "line_start", "line_end"]
    words = packs.select(
        *place,
        F.explode(
            F.array_distinct(
                F.regexp_extract_all(
                    F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), 0
                )
            )
        ).alias("word"),
    )
    # Words meet ids; the text comes last, and once per pair that met.
    near = asked.where("word IS NOT NULL").join(words, [*doc, "word"])
    others = asked.where("word IS NULL").join(packs.select(*place), doc)
    met = [*keys, *[c for c in place if c not in keys], "needle"]
    hits = (
        near.select(*met).unionByName(others.select(*met))
        .join(packs.select(*place, "page_start", "page_end", "content"), place)
        .where(F.contains(F.lower("content"), F.col("needle")))
    )
    order = F.struct("chunk_index", "line_start", "line_end")
    return hits.groupBy(*keys, *[c for c in pack if c not in keys]).agg(
        F.min_by(
            F.struct(
                "unit_id", "chunk_index", "page_start", "page_end", "content"
            ),
            order,
        ).alias("u")
    ).select(*keys, *[c for c in pack if c not in keys], "u.*")


# ---------------------------------------------------------------- finish rows


def grounded_labels(
    findings: DataFrame,
) -> DataFrame:
    """Coerce labels; a fact its excerpt does not ground becomes UNCERTAIN."""
    grounded = T.fact_grounded(
        F.col("fact"), F.col("data_points"), F.col("excerpt")
    )
    return findings.withColumns(
        {
            "grounded": grounded,
            "classification": F.when(
                grounded,
                T.coerce(F.col("classification"), W.ALLOWED_CLASSES, "INFERENCE"),
            ).otherwise("UNCERTAIN"),
            "confidence": F.when(
                grounded,
                T.coerce(F.col("confidence"), W.ALLOWED_CONFIDENCE, "MEDIUM"),
            ).otherwise("LOW"),
            "accounting_basis": T.coerce(
                F.col("accounting_basis"), W.ALLOWED_BASES, "NOT_CLEAR"
            ),
            "supporting_quote": F.col("excerpt"),
        }
    )


def number_text(c: Column) -> Column:
    """A number as source text writes it: no exponent, no trailing zeros."""
    whole = F.format_string("%.0f", c)
    fixed = F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    return F.when(c == F.floor(c), whole).otherwise(fixed)


def kept_calculations(calculations: Column, excerpt: Column) -> Column:
    """Proposed calculations whose inputs the excerpt shows, on one basis."""
    shown = T.signed_numbers(excerpt)

    def clean(c: Column) -> Column:
        return F.filter(c["inputs"], lambda i: calc.finite(i["value"]))

    def good(c: Column) -> Column:
        inputs = clean(c)
        named = F.filter(
            inputs["basis"], lambda b: b != calc.NOT_APPLICABLE
        )
        in_text = F.forall(
            inputs,
            lambda i: F.array_contains(shown, number_text(i["value"]))
            | F.array_contains(
                shown,
                F.format_string(
                    "%.0f", F.floor(i["value"] + 0.5).cast("double")
                ),
            ),
        )
        return (
            calc.finite(c["result"])
            & (F.size(inputs) > 0)
            & in_text
            & (F.size(F.array_distinct(named)) <= 1)
        )

    return F.filter(calculations, good)
