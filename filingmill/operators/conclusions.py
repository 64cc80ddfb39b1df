"""Admission of section conclusions and the summary built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill.functions import calc
from filingmill.functions import text as T
from filingmill.functions.rows import compute_once
from filingmill.operators.qa import exact_units
from filingmill.rules import research as R
from filingmill.rules import words as W

KEY = ["company_id", "document_id", "section_key", "pos"]
SCOPE = KEY[:3]
MAX_CONCLUSIONS = 5
SHARED_WORDS = 0.68
REPORTED_BASES = ["CONSOLIDATED", "STANDALONE"]


def scope_pattern(alternatives: str, whole_word: bool) -> str:
    tail = r"(?![A-Za-z0-9_])" if whole_word else ""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{alternatives}){tail}"


def in_scope(section: Column, claim: Column, scopes: Mapping = R.SECTION_SCOPE) -> Column:
    """Does the claim match its section's scope? Unknown sections do not."""
    chain = None
    for name, (alternatives, whole_word) in scopes.items():
        hit = claim.rlike(scope_pattern(alternatives, whole_word))
        here = section == name
        chain = F.when(here, hit) if chain is None else chain.when(here, hit)
    return chain.otherwise(False)


def best_excerpt(
    claims: DataFrame, units: DataFrame, keys: Sequence[str],
    subjects: Sequence[Sequence[str]] = W.SUBJECT_PATTERNS,
) -> DataFrame:
    """The unit that supports each claim best.

    ``units`` holds the candidate units of each claim under the same keys
    (its cited units). A unit must hold all numbers of the claim, name its
    subjects near them, and contain at least four claim words. Ties go to the
    shorter unit, then to the earlier one.
    """
    # What depends on the claim alone is found once, not once per unit. Most
    # claims name no subject, so that their text need not be moved.
    claim = F.col("claim")
    named = reduce(
        lambda a, b: a | b,
        [claim.rlike(T.ascii_words("|".join(s))) for s in subjects], F.lit(False),
    )
    asked = compute_once(
        claims.select(*keys, "claim"), _numbers=T.grouped_numbers(claim),
        _words=T.meaningful_words(claim), _named=F.when(named, claim),
    ).drop("claim")
    rows = asked.join(units.select(*keys, "cite_pos", "content"), list(keys))
    # Numbers need no normal form, so most units leave before Python is asked.
    missing = T.missing_from(F.col("_numbers"), T.grouped_numbers(F.col("content")))
    rows = rows.where(F.when(F.size("_numbers") == 0, True).otherwise(F.size(missing) == 0))
    rows = rows.withColumn("_plain", T.nfkc(F.col("content")))
    supported = T.subject_supported(F.col("_named"), F.col("_text"), subjects)
    rows = (
        compute_once(rows, _text=T.evidence_normalise(F.col("_plain")))
        .where(F.when(F.col("_named").isNull(), True).otherwise(supported))
    )
    rows = compute_once(
        rows, _hits=T.count_contained(F.col("_words"), F.col("_text"))
    ).where(F.col("_hits") >= F.least(F.lit(4), F.size("_words")))
    score = F.col("_hits") * 3 + F.size("_numbers") * 4
    order = F.struct(-score, F.length("content"), F.col("cite_pos"))
    return rows.groupBy(*keys).agg(
        F.min_by("content", order).alias("excerpt"),
        F.max(score).cast("bigint").alias("excerpt_score"),
    )


def basis_flags(units: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: do the cited chunks name a consolidated, a standalone basis?

    Chunk text is reduced to two flags before the join.
    """
    group, alone = T.basis_words(F.col("content"))
    doc = ["company_id", "document_id"]
    flags = chunks.select(
        *doc, "chunk_index", group.alias("group"), alone.alias("alone")
    )
    return (
        units.select(*keys, *[c for c in doc if c not in keys], "chunk_index")
        .distinct()
        .join(flags, [*doc, "chunk_index"])
        .groupBy(*keys)
        .agg(
            F.bool_or("group").alias("names_group"),
            F.bool_or("alone").alias("names_alone"),
        )
    )


def basis_established(basis: Column) -> Column:
    return F.coalesce(
        F.when(basis == "CONSOLIDATED", F.col("names_group"))
        .when(basis == "STANDALONE", F.col("names_alone"))
        .otherwise(False),
        F.lit(False),
    )


def judge_conclusions(
    conclusions: DataFrame, packs: DataFrame, chunks: DataFrame,
    scopes: Mapping = R.SECTION_SCOPE,
    subjects: Sequence[Sequence[str]] = W.SUBJECT_PATTERNS,
) -> DataFrame:
    """Every conclusion with its verdict: NULL reason means accepted.

    The reason is the first failing rule: schema, citation, support, scope,
    basis. Accepted facts with an interpretive phrase become inferences, and
    no inference stays at HIGH confidence.
    """
    rows = compute_once(
        conclusions,
        claim=T.trim_space(F.coalesce("claim", F.lit(""))),
        classification=F.upper(T.trim_space(F.col("classification"))),
        confidence=F.upper(T.trim_space(F.col("confidence"))),
        accounting_basis=F.upper(T.trim_space(F.col("accounting_basis"))),
    )
    units = exact_units(rows.select(*KEY, "evidence_ids"), packs, KEY)
    cites = F.struct(
        "chunk_index", "page_start", "page_end",
        F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"))
        .alias("chunk_label"),
    )
    cited = units.groupBy(*KEY, "chunk_index").agg(
        F.min("cite_pos").alias("cite_pos"),
        F.max_by(cites, F.col("cite_pos")).alias("cite"),
    ).groupBy(*KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("cite_pos", "cite"))),
            lambda x: x["cite"],
        ).alias("citations")
    )
    joined = (
        rows.join(cited, KEY, "left")
        .join(best_excerpt(rows, units, KEY, subjects), KEY, "left")
        .join(basis_flags(units, chunks, KEY), KEY, "left")
    )
    uncertain = F.col("classification") == "UNCERTAIN"
    excerpt = F.when(~uncertain, F.col("excerpt"))
    joined = joined.withColumn("excerpt", excerpt).withColumn(
        "_plain", T.nfkc(F.col("excerpt"))
    )
    claim_col, quote = F.col("claim"), F.col("excerpt")
    joined = compute_once(
        joined,
        financial_figure=T.is_financial_figure(
            claim_col, quote, F.col("financial_figure")
        ),
        _supported=F.coalesce(
            T.claim_supported(claim_col, quote)
            & T.subject_supported(claim_col, F.col("_plain"), subjects),
            F.lit(False),
        ),
        _scoped=in_scope(F.col("section_key"), claim_col, scopes),
    )
    schema_ok = (
        (claim_col != "")
        & F.coalesce(F.col("classification").isin(W.ALLOWED_CLASSES), F.lit(False))
        & F.coalesce(F.col("confidence").isin(W.ALLOWED_CONFIDENCE), F.lit(False))
        & F.coalesce(F.col("accounting_basis").isin(W.ALLOWED_BASES), F.lit(False))
    )
    basis_ok = F.col("accounting_basis").isin(
        REPORTED_BASES
    ) & basis_established(F.col("accounting_basis"))
    reason = (
        F.when(~schema_ok, "SCHEMA")
        .when(~uncertain & F.col("citations").isNull(), "NO_CITATION")
        .when(~uncertain & ~F.col("_supported"), "NOT_SUPPORTED")
        .when(~uncertain & ~F.col("_scoped"), "OUT_OF_SCOPE")
        .when(F.col("financial_figure") & ~basis_ok, "BASIS_NOT_ESTABLISHED")
    )
    relabelled = F.when(
        (F.col("classification") == "FACT")
        & T.has_interpretation(claim_col, quote),
        "INFERENCE",
    ).otherwise(F.col("classification"))
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("classification", relabelled)
        .withColumn(
            "confidence",
            F.when(
                (F.col("classification") == "INFERENCE")
                & (F.col("confidence") == "HIGH"),
                "MEDIUM",
            ).otherwise(F.col("confidence")),
        )
        .select(
            *KEY, "claim", "classification", "confidence", "financial_figure",
            "accounting_basis", F.col("excerpt").alias("data_point"),
            F.coalesce(
                "citations",
                F.array().cast(
                    "array<struct<chunk_index:int,page_start:int,"
                    "page_end:int,chunk_label:string>>"
                ),
            ).alias("citations"),
            "reject_reason",
        )
    )


VAGUE_NOTE = r"(?i)^no (?:material|significant|specific).*(?:identified|issues|established)"


def drop_vague_notes(notes: Column) -> Column:
    """Drop empty notes and vague \"no material ... identified\" ones."""
    return F.filter(
        F.transform(notes, lambda n: T.trim_space(n)),
        lambda n: (n != "") & ~n.rlike(VAGUE_NOTE),
    )


def merged_notes(notes: Column, rejections: Column) -> Column:
    """Distinct union of insufficiency notes and rejections."""
    return F.array_union(drop_vague_notes(notes), rejections)


def anchored_claim_ok() -> Column:
    """Check of a claim tied to fixed excerpts, on one row.

    Uses claim, data_point, citations, financial_figure, accounting_basis,
    classification, names_group and names_alone. A figure missing from the
    source passes only as the result of "a less b" of two quoted amounts.
    """
    basis_ok = F.col("accounting_basis").isin(
        REPORTED_BASES
    ) & basis_established(F.col("accounting_basis"))
    claim = F.col("claim")
    missing = T.missing_from(
        T.without_years_and_days(T.grouped_numbers(claim)),
        T.grouped_numbers(F.col("data_point")),
    )
    amounts = F.transform(
        F.regexp_extract_all(claim, F.lit(r"₹\s*([\d,]+(?:\.\d+)?)"), 1),
        lambda a: T.parse_number(a),
    )
    first = F.get(amounts, F.lit(0))
    rest = calc.free_cash_flow(
        F.get(amounts, F.lit(1)), F.get(amounts, F.lit(2))
    )
    subtraction = (
        (F.col("classification") == "INFERENCE")
        & claim.rlike("(?i)less reported capex|minus")
        & (F.size(amounts) >= 3)
        & (F.abs(first - rest) < 0.01)
        & F.forall(missing, lambda m: T.parse_number(m) == first)
    )
    has_source = (F.size("citations") > 0) & (
        F.coalesce("data_point", F.lit("")) != ""
    )
    return (
        has_source
        & (~F.col("financial_figure") | basis_ok)
        & ((F.size(missing) == 0) | F.coalesce(subtraction, F.lit(False)))
    )


# --------------------------------------------------- shortest matching window


def shortest_excerpt(
    content: Column, patterns: Sequence[str], max_lines: int = 8,
    max_chars: int = 8_000, before: int = 180, after: int = 240,
) -> Column:
    """Shortest run of lines that matches all patterns, then cropped.

    Falls back to the whole text in one line; NULL when that fails as well.
    The crop keeps some text before the first and after the last match.
    """
    lines = F.filter(
        F.transform(F.split(content, "\n"), lambda x: T.trim_space(x)),
        lambda x: x != "",
    )

    def matches(text: Column) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & text.rlike(p)
        return out

    def runs(i: Column) -> Column:
        sizes = F.sequence(
            F.lit(1), F.least(F.lit(max_lines), F.size(lines) - i + 1)
        )
        return F.transform(
            sizes,
            lambda k: F.struct(
                F.array_join(F.slice(lines, i, k), " ").alias("text"),
                i.alias("i"), k.alias("k"),
            ),
        )

    found = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size(lines)), runs)),
        lambda w: (F.length(w["text"]) <= max_chars) & matches(w["text"]),
    )
    found = F.when(F.size(lines) > 0, found)
    best = F.array_min(
        F.transform(
            found,
            lambda w: F.struct(
                F.length(w["text"]).alias("n"), w["i"].alias("i"),
                w["k"].alias("k"), w["text"].alias("text"),
            ),
        )
    )["text"]
    whole = T.collapse(content)
    text = F.coalesce(best, F.when(matches(whole), whole))

    # Matches at the very start of the text do not widen the crop.
    spans = F.filter(
        F.array(
            *[
                F.struct(
                    (F.regexp_instr(text, F.lit(p)) - 1).alias("start"),
                    (
                        F.regexp_instr(text, F.lit(p)) - 1
                        + F.length(F.regexp_substr(text, F.lit(p)))
                    ).alias("stop"),
                )
                for p in patterns
            ]
        ),
        lambda s: s["start"] > 0,
    )
    start = F.greatest(F.lit(0), F.array_min(spans["start"]) - before)
    stop = F.least(F.length(text), F.array_max(spans["stop"]) + after)
    cropped = T.trim_space(F.substring(text, start + 1, stop - start))
    return F.when(F.size(spans) > 0, cropped).otherwise(text)


# -------------------------------------------------------- near-duplicate claims


def merge_claims(
    anchors: DataFrame,
    claims: DataFrame,
    anchor_only: Sequence[str] = tuple(R.ANCHOR_ONLY_SECTIONS),
    overlap_sections: Sequence[str] = ("risks",),
    keep: int = MAX_CONCLUSIONS,
) -> DataFrame:
    """Anchored claims first, then the generated ones that add something.

    A generated claim is dropped when it holds all numbers of an earlier kept
    claim. In sections compared by words, a claim is also dropped when it
    shares 68 percent of the smaller word set with any earlier candidate. The
    first five are kept and numbered.

    A section holds the few claims of one model answer, so its claims are
    folded as one array, which is bounded by that answer.
    """
    rows = anchors.withColumn("is_anchor", F.lit(True)).unionByName(
        claims.withColumn("is_anchor", F.lit(False)), allowMissingColumns=True
    )
    claim = F.struct(
        (~F.col("is_anchor")).alias("generated"), F.col("pos").alias("pos"),
        F.col("claim").alias("claim"),
        F.col("classification").alias("classification"),
        T.grouped_numbers(F.col("claim")).alias("numbers"),
        T.meaningful_words(F.col("claim")).alias("words"),
    )
    grouped = rows.groupBy(*SCOPE).agg(
        F.array_sort(F.collect_list(claim)).alias("listed")
    )
    has_anchor = F.exists("listed", lambda c: ~c["generated"])
    allowed = F.filter(
        "listed",
        lambda c: ~c["generated"]
        | ~(
            has_anchor
            & (
                F.col("section_key").isin(list(anchor_only))
                | (c["classification"] == "UNCERTAIN")
            )
        ),
    )

    def numbers_held(kept: Column, new: Column) -> Column:
        return F.exists(
            kept,
            lambda k: (F.size(k["numbers"]) > 0)
            & (F.size(F.array_except(k["numbers"], new["numbers"])) == 0),
        )

    def add(kept: Column, new: Column) -> Column:
        drop = new["generated"] & numbers_held(kept, new)
        return F.when(drop, kept).otherwise(F.array_append(kept, new))

    merged = F.aggregate(allowed, F.slice(F.col("listed"), 1, 0), add)
    grouped = grouped.withColumn("merged", merged)

    def overlaps(a: Column, b: Column) -> Column:
        smaller = F.least(F.size(a["words"]), F.size(b["words"]))
        shared = F.size(F.array_intersect(a["words"], b["words"]))
        return (smaller > 0) & (shared / smaller >= SHARED_WORDS)

    distinct = F.filter(
        "merged",
        lambda c, i: ~F.exists(
            F.slice(F.col("merged"), F.lit(1), i), lambda e: overlaps(e, c)
        ),
    )
    chosen = F.when(
        F.col("section_key").isin(list(overlap_sections)), distinct
    ).otherwise(F.col("merged"))
    return (
        grouped.select(
            *SCOPE, F.posexplode(F.slice(chosen, 1, keep)).alias("i", "c")
        )
        .select(
            *SCOPE, "c.pos", "c.claim", "c.classification",
            (~F.col("c.generated")).alias("is_anchor"),
            F.concat_ws(
                "-", "section_key", (F.col("i") + 1).cast("string")
            ).alias("conclusion_id"),
        )
    )


def section_status(
    conclusions: DataFrame, keys: Sequence[str] = tuple(SCOPE),
    sections: DataFrame | None = None,
) -> DataFrame:
    """COMPLETE when a section has a supported conclusion.

    ``sections`` lists all sections; one without conclusions is INSUFFICIENT.
    """
    found = conclusions.groupBy(*keys).agg(
        F.count("*").alias("n_conclusions"),
        F.count_if(F.col("classification") != "UNCERTAIN")
        .alias("n_supported"),
        F.when(
            F.bool_or(F.col("classification") != "UNCERTAIN"), "COMPLETE"
        ).otherwise("INSUFFICIENT").alias("status"),
    )
    if sections is None:
        return found
    return (
        sections.select(*keys).distinct().join(found, list(keys), "left")
        .na.fill(0, ["n_conclusions", "n_supported"])
        .na.fill("INSUFFICIENT", ["status"])
    )


def uncertain_rows(status: DataFrame) -> DataFrame:
    """One explicit UNCERTAIN row for each section without a supported conclusion."""
    return status.where("status = 'INSUFFICIENT' AND n_conclusions = 0").select(
        *SCOPE,
        F.lit(0).cast("bigint").alias("pos"),
        F.lit("Insufficient evidence for this section.").alias("claim"),
        F.lit("UNCERTAIN").alias("classification"),
        F.lit("LOW").alias("confidence"),
        F.lit("NOT_APPLICABLE").alias("accounting_basis"),
    )


def number_survivors(
    rows: DataFrame, keys: Sequence[str], order: Sequence, keep: int = MAX_CONCLUSIONS
) -> DataFrame:
    """Number the accepted rows of a section and keep the first ones."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("number", F.row_number().over(window))
        .where(F.col("number") <= keep)
        .withColumn(
            "conclusion_id",
            F.concat_ws("-", F.col(keys[-1]), F.col("number").cast("string")),
        )
    )


# -------------------------------------------------------------------- summary


def summary_sources(items: DataFrame, conclusions: DataFrame) -> DataFrame:
    """Summary items exploded to the supported conclusions they cite."""
    doc = ["company_id", "document_id"]
    sources = conclusions.where(F.col("classification") != "UNCERTAIN").select(
        *doc, F.col("conclusion_id"), "claim", "confidence",
        "financial_figure", "accounting_basis", "citations",
    )
    return items.select(
        *doc, "item_key",
        F.posexplode("source_ids").alias("source_pos", "conclusion_id"),
    ).join(sources, [*doc, "conclusion_id"])


def resolve_summary(
    items: DataFrame,
    conclusions: DataFrame,
    fallback: Mapping[str, Sequence[str]] = R.SUMMARY_FALLBACK,
) -> DataFrame:
    """Final text and sources of each summary item.

    If one cited claim holds all numbers of the item, that claim replaces it.
    If the item is empty, cites nothing or holds an unsupported number, the
    first supported claims of its preferred sections replace it.
    """
    doc = ["company_id", "document_id"]
    item = [*doc, "item_key"]
    cited = summary_sources(items, conclusions)
    source = F.struct(
        "source_pos", "conclusion_id", "claim", "confidence",
        "financial_figure", "accounting_basis", "citations",
    )
    joined = items.join(
        cited.groupBy(*item).agg(
            F.array_sort(F.collect_list(source)).alias("sources")
        ),
        item, "left",
    )
    empty = F.slice(F.col("sources"), 1, 0)
    numbers = T.grouped_numbers(F.col("text"))
    exact = F.get(
        F.filter(
            "sources",
            lambda s: F.size(
                T.missing_from(numbers, T.grouped_numbers(s["claim"]))
            ) == 0,
        ),
        F.lit(0),
    )
    exact = F.when(F.size(numbers) > 0, exact)
    all_text = F.array_join(F.col("sources.claim"), " ")
    loose = F.size(T.missing_from(numbers, T.grouped_numbers(all_text))) > 0
    needs_fallback = (
        (T.trim_space(F.coalesce("text", F.lit(""))) == "")
        | F.col("sources").isNull()
        | loose
    )
    wanted = F.create_map(
        *[
            x for k, s in fallback.items()
            for x in (F.lit(k), F.array(*[F.lit(v) for v in s]))
        ]
    )
    preferred = (
        items.select(
            *item,
            F.posexplode(
                F.try_element_at(wanted, F.col("item_key"))
            ).alias("section_pos", "section_key"),
        )
        .join(
            conclusions.where(F.col("classification") != "UNCERTAIN"),
            [*doc, "section_key"],
        )
        .groupBy(*item)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "section_pos", "pos", "conclusion_id", "claim",
                        "confidence", "financial_figure", "accounting_basis",
                        "citations",
                    )
                )
            ).alias("preferred")
        )
    )
    n = F.when(F.col("item_key") == "investorTakeaway", 3).otherwise(1)
    fields = [
        "conclusion_id", "claim", "confidence", "financial_figure",
        "accounting_basis", "citations",
    ]

    def plain(listed: Column) -> Column:
        return F.transform(
            listed, lambda s: F.struct(*[s[f].alias(f) for f in fields])
        )

    rows = joined.join(preferred, item, "left").withColumns(
        {"_exact": exact, "_fallback": needs_fallback}
    )
    chosen = (
        F.when(F.col("_exact").isNotNull(), plain(F.array("_exact")))
        .when(F.col("_fallback"), plain(F.slice("preferred", F.lit(1), n)))
        .otherwise(plain(F.coalesce("sources", empty)))
    )
    rows = rows.withColumn("chosen", chosen)
    text = (
        F.when(F.col("_exact").isNotNull(), F.col("_exact.claim"))
        .when(
            F.col("_fallback"),
            F.coalesce(
                F.array_join(F.col("chosen.claim"), " "),
                F.lit(
                    "The annual report evidence was insufficient for a "
                    "reliable conclusion."
                ),
            ),
        )
        .otherwise(F.col("text"))
    )
    return rows.select(
        *item, text.alias("text"),
        F.coalesce(
            F.col("chosen.conclusion_id"), F.array().cast("array<string>")
        ).alias("source_ids"),
        summary_labels(text).alias("labels"),
        F.flatten("chosen.citations").alias("citations"),
    )


def summary_labels(text: Column) -> Column:
    """Class, confidence and basis of a summary item from its sources."""
    chosen = F.col("chosen")
    n = F.coalesce(F.size(chosen), F.lit(0))
    low = F.exists(chosen, lambda s: s["confidence"] == "LOW")
    financial = F.filter(chosen, lambda s: s["financial_figure"])
    bases = F.array_distinct(
        F.filter(
            financial["accounting_basis"], lambda b: b.isin(REPORTED_BASES)
        )
    )
    figure = (F.size(T.grouped_numbers(text)) > 0) & (F.size(financial) > 0)
    figure = F.coalesce(figure, F.lit(False))
    return F.struct(
        F.when(n > 0, "INFERENCE").otherwise("UNCERTAIN")
        .alias("classification"),
        F.when((n > 0) & ~low, "MEDIUM").otherwise("LOW").alias("confidence"),
        figure.alias("financial_figure"),
        F.when(figure & (F.size(bases) == 1), F.get(bases, F.lit(0)))
        .when(figure, "NOT_CLEAR").otherwise("NOT_APPLICABLE")
        .alias("accounting_basis"),
    )
