"""Report rows: section assembly, evidence rows, gates and parse-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.operators.conclusions import REPORTED_BASES
from filingmill.rules import metrics as M
from filingmill.rules import research as R

RUN = ["company_id", "document_id"]
FINDINGS_LINE = "\n--- Detailed findings ---"
TABLE_BLOCK = r"(?s)\[TABLE\](\{.*?\})\[/TABLE\]"
MIN_CONCLUSIONS = 24
MIN_SECTIONS = 16
#: Rows of a block where blocks meet blocks.
BLOCK = 1024
TABLE_SCHEMA = (
    "title STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>, "
    "footnote STRING"
)


# --------------------------------------------------------------- source labels


def page_texts(citations: Column) -> Column:
    return F.array_distinct(
        F.transform(
            citations,
            lambda c: F.when(
                c["page_start"] == c["page_end"],
                c["page_start"].cast("string"),
            ).otherwise(
                F.concat_ws(
                    "-", c["page_start"].cast("string"),
                    c["page_end"].cast("string"),
                )
            ),
        )
    )


def chunk_texts(citations: Column) -> Column:
    return F.array_distinct(
        F.transform(citations, lambda c: c["chunk_index"].cast("string"))
    )


def source_label(title: Column, citations: Column, basis: Column) -> Column:
    """Where a claim comes from: document, pages, chunks and basis."""
    pages = page_texts(citations)
    tag = F.when(
        basis.isin(REPORTED_BASES),
        F.concat(F.lit("; "), basis, F.lit(" basis")),
    ).otherwise("")
    return F.when(
        F.size(pages) <= 0,
        F.concat(title, F.lit("; evidence insufficient"), tag),
    ).otherwise(
        F.concat(
            title, F.lit(", page "), F.array_join(pages, ", "),
            F.lit(", chunk "), F.array_join(chunk_texts(citations), ", "), tag,
        )
    )


def page_reference(citations: Column) -> Column:
    return F.when(
        F.size(citations) <= 0, "Annual report evidence insufficient"
    ).otherwise(
        F.concat(
            F.lit("Annual Report p. "),
            F.array_join(page_texts(citations), ", "),
            F.lit(" · chunks "), F.array_join(chunk_texts(citations), ", "),
        )
    )


def conclusion_text(
    claim: Column, classification: Column, confidence: Column,
    figure: Column, basis: Column, citations: Column,
) -> Column:
    """Display text of one conclusion with its label line."""
    label = (
        F.when(classification == "UNCERTAIN", "Insufficient evidence")
        .when(classification == "FACT", "Fact").otherwise("Inference")
    )
    tag = F.when(
        figure & basis.isin(REPORTED_BASES),
        F.concat(F.lit(" · "), F.lower(basis)),
    ).otherwise("")
    return F.concat(
        claim, F.lit("\n["), label, F.lit(" · "), F.lower(confidence),
        F.lit(" confidence"), tag, F.lit(" | "), page_reference(citations),
        F.lit("]"),
    )


# ------------------------------------------------------------- evidence rows


def evidence_rows(
    findings: DataFrame, documents: DataFrame, default_period: str | None = None
) -> DataFrame:
    """Supported findings -> stored evidence rows."""
    titles = documents.select(
        *RUN, "title",
        F.coalesce("publication_date", "document_date").alias("source_date"),
    )
    points = F.array_join(F.col("data_points"), " | ")
    return (
        findings.where(~F.col("insufficient_evidence"))
        .join(titles, RUN, "left")
        .select(
            *RUN, "finding_id", "report_section",
            F.coalesce(
                F.nullif("period", F.lit("")), F.lit(default_period)
            ).alias("period"),
            F.col("fact").alias("claim"),
            F.col("classification").alias("evidence_type"),
            source_label(
                F.col("title"), F.col("citations"), F.col("accounting_basis")
            ).alias("supporting_source"),
            "source_date",
            F.when(
                F.size("data_points") > 0,
                F.concat(
                    F.lit("["), "accounting_basis", F.lit("] "), points
                ),
            ).alias("data_point"),
            F.nullif("analysis", F.lit("")).alias("ai_interpretation"),
            F.col("confidence").alias("confidence_level"),
        )
    )


def conclusion_rows(
    section_conclusions: DataFrame, summary_conclusions: DataFrame
) -> DataFrame:
    """Section and summary conclusions as evidence rows."""
    rows = section_conclusions.unionByName(
        summary_conclusions, allowMissingColumns=True
    )
    return rows.select(
        *RUN,
        F.col("section_key").alias("report_section"), "claim",
        F.col("classification").alias("evidence_type"),
        F.when(
            F.col("financial_figure"),
            F.concat(F.lit("["), "accounting_basis", F.lit("] "), "data_point"),
        ).otherwise(F.col("data_point")).alias("data_point"),
        F.when(F.col("classification") == "INFERENCE", F.col("claim"))
        .alias("ai_interpretation"),
        F.col("confidence").alias("confidence_level"),
    )


# ----------------------------------------------------------- section assembly


def finding_text() -> Column:
    """Text block of one finding."""
    lines = F.transform(
        "calculations",
        lambda c: F.concat(
            F.lit("• "), c["metric"], F.lit(": "), c["result_label"],
            F.lit("  ("), c["formula"], F.lit(", "), c["period"], F.lit(")"),
        ),
    )
    calculations = F.when(
        F.size("calculations") > 0,
        F.concat(F.lit("\nCalculations:\n"), F.array_join(lines, "\n")),
    )
    kind = (
        F.when(F.col("classification") == "FACT", "Fact")
        .when(F.col("classification") == "INFERENCE", "Inference")
        .otherwise("Uncertain")
    )
    basis = F.when(
        F.col("accounting_basis") == "NOT_APPLICABLE", "n/a basis"
    ).otherwise(F.lower("accounting_basis"))
    tag = F.concat(
        F.lit("["), kind, F.lit(" · "), F.lower("confidence"),
        F.lit(" confidence · "), basis, F.lit(" · Source: annual report]"),
    )

    def labelled(name: str, label: str) -> Column:
        value = F.nullif(F.col(name), F.lit(""))
        return F.concat(F.lit(label), value)

    return F.concat_ws(
        "\n", F.nullif(F.col("fact"), F.lit("")),
        labelled("analysis", "Analysis: "),
        labelled("investor_implication", "Investor implication: "),
        calculations, tag,
    )


def fallback_narrative(findings: DataFrame) -> DataFrame:
    """Plain narrative per section from its findings, in finding order."""
    implication = F.nullif(
        T.trim_space(F.col("investor_implication")), F.lit("")
    )
    text = F.concat_ws(
        " ", F.nullif(T.trim_space(F.col("fact")), F.lit("")),
        F.nullif(T.trim_space(F.col("analysis")), F.lit("")),
        F.concat(F.lit("Investor implication: "), implication),
    )
    part = F.struct("finding_pos", text.alias("text"))
    return findings.groupBy(*RUN, "report_section").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(part)), lambda p: p["text"]
            ),
            "\n\n",
        ).alias("narrative")
    )


def findings_by_section(
    runs: DataFrame, findings: DataFrame,
    sections: Sequence[tuple[str, str]] = tuple(R.REPORT_SECTIONS),
) -> DataFrame:
    """Every report section of every run with its findings or a stub.

    Each run is exploded to the fixed list of sections, then the counts are
    joined.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("section_pos"),
                F.lit(k).alias("report_section"), F.lit(t).alias("title"),
            )
            for i, (k, t) in enumerate(sections)
        ]
    )
    counts = findings.groupBy(*RUN, "report_section").agg(
        F.count("*").alias("n_findings")
    )
    grid = runs.select(*RUN).distinct().select(
        *RUN, F.explode(listed).alias("s")
    ).select(*RUN, "s.*")
    stub = F.concat(
        F.lit("No supported findings were established for "), "title",
        F.lit("."),
    )
    return (
        grid.join(counts, [*RUN, "report_section"], "left")
        .na.fill(0, ["n_findings"])
        .withColumn("stub", F.when(F.col("n_findings") == 0, stub))
    )


def assemble_sections(narratives: DataFrame, findings: DataFrame) -> DataFrame:
    """Narrative, embedded tables and a findings block per section.

    ``narratives`` has narrative and ``tables`` (array of JSON texts) per run
    and section. A section without any text is left out.
    """
    keys = [*RUN, "report_section"]
    block = F.struct(
        "finding_pos",
        F.concat(F.lit("\n"), T.scrub_ids(finding_text())).alias("text"),
    )
    details = (
        findings.where(~F.col("insufficient_evidence"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    )
    rows = narratives.join(details, keys, "full_outer")
    tables = F.transform(
        F.coalesce("tables", F.array().cast("array<string>")),
        lambda t: F.concat(F.lit("\n[TABLE]"), t, F.lit("[/TABLE]")),
    )
    texts = F.transform(
        F.coalesce(
            "blocks",
            F.array().cast("array<struct<finding_pos:bigint,text:string>>"),
        ),
        lambda b: b["text"],
    )
    head = F.when(F.size(texts) > 0, F.array(F.lit(FINDINGS_LINE))).otherwise(
        F.array().cast("array<string>")
    )
    story = F.nullif(T.scrub_ids(F.col("narrative")), F.lit(""))
    content = T.trim_space(
        F.array_join(
            F.concat(F.array_compact(F.array(story)), tables, head, texts),
            "\n",
        )
    )
    return rows.select(*keys, content.alias("content")).where(
        F.col("content") != ""
    )


def parse_section(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Section text -> blocks: narrative, table or findings, in order.

    A table block whose JSON is malformed is ignored.
    """
    marked = F.regexp_replace("content", TABLE_BLOCK, "\u0001T$1\u0001")
    pieces = F.split(marked, "\u0001")
    is_table = F.col("piece").startswith("T{")
    split = (
        rows.select(*keys, F.posexplode(pieces).alias("piece_pos", "piece"))
        .withColumn("is_table", is_table & (F.col("piece_pos") % 2 == 1))
    )
    table = F.from_json(F.expr("substring(piece, 2)"), TABLE_SCHEMA)
    parts = F.split(
        F.col("piece"), r"(?i)\n?---\s*Detailed findings\s*---\n?"
    )
    exploded = split.select(
        *keys, "piece_pos", "is_table",
        F.when(F.col("is_table"), table).alias("table"),
        F.posexplode(
            F.when(F.col("is_table"), F.array("piece")).otherwise(parts)
        ).alias("part_pos", "text"),
    ).withColumn("text", T.trim_space(F.col("text")))
    good_table = F.col("table.headers").isNotNull() & F.col(
        "table.rows"
    ).isNotNull()
    kind = (
        F.when(F.col("is_table"), "table")
        .when(F.col("part_pos") > 0, "findings").otherwise("narrative")
    )
    return exploded.where(
        (F.col("is_table") & good_table)
        | (~F.col("is_table") & (F.col("text") != ""))
    ).select(
        *keys,
        (F.col("piece_pos") * 1000 + F.col("part_pos")).alias("block_pos"),
        kind.alias("kind"),
        F.when(~F.col("is_table"), F.col("text")).alias("text"),
        F.when(F.col("is_table"), F.col("table")).alias("table"),
    )


# -------------------------------------------------------------- display, gates


def latest_sections(research: DataFrame, order: str = "created_at") -> DataFrame:
    """The last row per company and section."""
    last = F.struct(order, "research_id")
    values = [
        c for c in research.columns if c not in ("company_id", "section")
    ]
    return research.groupBy("company_id", "section").agg(
        F.max_by(F.struct(*values), last).alias("r")
    ).select("company_id", "section", "r.*")


def orphan_sections(research: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose section is in no display group."""
    return research.join(groups.select("section"), "section", "left_anti")


def grouped_sections(research: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of display groups; empty contents and empty groups vanish."""
    return research.where(
        T.trim_space(F.coalesce("content", F.lit(""))) != ""
    ).join(groups, "section")


def summary_seed(
    findings: DataFrame, sections: Sequence[str] = tuple(R.SUMMARY_SEED_SECTIONS),
    per_section: int = 3,
) -> DataFrame:
    """First findings of the seed sections; only then drop insufficient ones."""
    window = Window.partitionBy(*RUN, "report_section").orderBy("finding_pos")
    return (
        findings.where(F.col("report_section").isin(list(sections)))
        .withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= per_section)
        .where(~F.col("insufficient_evidence"))
        .drop("_rn")
    )


def publish_gate(
    conclusions: DataFrame, keys: Sequence[str] = tuple(RUN),
    min_conclusions: int = MIN_CONCLUSIONS, min_sections: int = MIN_SECTIONS,
) -> DataFrame:
    """May a run be published?

    Counts are taken per section first, so a run that holds most of the rows
    is reduced before its own group is formed.
    """
    supported = F.col("classification") != "UNCERTAIN"
    per_section = conclusions.groupBy(*keys, "section_key").agg(
        F.count_if(supported).alias("n")
    )
    return (
        per_section.groupBy(*keys)
        .agg(
            F.sum("n").alias("supported_conclusions"),
            F.count_if(F.col("n") > 0).alias("complete_sections"),
            F.count("*").alias("n_sections"),
        )
        .withColumn(
            "publishable",
            (F.col("supported_conclusions") >= min_conclusions)
            & (F.col("complete_sections") >= min_sections),
        )
    )


def lineage(
    conclusions: DataFrame, evidence: DataFrame, metrics: DataFrame,
    registry: DataFrame,
) -> DataFrame:
    """Conclusion -> evidence -> metric -> source registry, one row per link.

    Conclusions without evidence stay, with NULLs. The rows are not gathered
    into lists: a conclusion may rest on any number of records.
    """
    return (
        conclusions.join(evidence, "conclusion_id", "left")
        .join(metrics, "metric_id", "left")
        .join(
            registry.select("source_name", "tier", "tier_label"),
            "source_name", "left",
        )
        .select(
            "conclusion_id", "conclusion", "evidence_id", "metric_id",
            "source_name", "tier", "tier_label", "accounting_basis",
            "reporting_period",
        )
    )


def _exploded(rows: DataFrame, table: dict, key: str, name: str) -> DataFrame:
    pairs = [
        x for k, v in table.items()
        for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))
    ]
    return rows.withColumn(
        name, F.explode(F.try_element_at(F.create_map(*pairs), F.col(key)))
    )


def affected_sections(items: DataFrame) -> DataFrame:
    """Report sections an item's source type can change."""
    return _exploded(items, M.SOURCE_SECTIONS, "source_type", "report_section")


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of equal keys as arrays ``name`` of at most ``BLOCK`` rows.

    A single column is an array of its plain values, which are read faster.
    """
    rest = [c for c in rows.columns if c not in keys]
    # Blocks are the same when a lost task runs again: only equal rows tie.
    place = Window.partitionBy(*keys).orderBy(*(rest or keys))
    block = F.floor((F.row_number().over(place) - 1) / BLOCK)
    item = F.struct(*rest) if rest else F.struct(F.lit(True).alias("row"))
    lists = rows.withColumn(f"{name}_block", block).groupBy(
        *keys, f"{name}_block"
    ).agg(F.collect_list(item).alias(name))
    plain = F.transform(name, lambda x: x[rest[0]]) if len(rest) == 1 else F.col(name)
    return lists.withColumn(name, plain)


def _fields(rest: list[str], name: str) -> list[Column]:
    """The columns of an element of ``_blocks``."""
    if len(rest) == 1:
        return [F.col(name).alias(rest[0])]
    return [F.col(f"{name}.{c}").alias(c) for c in rest]


def section_checks(
    sections: DataFrame, checks: DataFrame, also: Sequence[str] = ()
) -> DataFrame:
    """Research checks of each section, through its check categories.

    ``also`` names further columns that both sides share; with large lists of
    checks they bound how many of them a section meets.

    The result has a row per section and check, far more than both tables. So
    blocks of sections meet blocks of checks, and the pairs of blocks are dealt
    to tasks before they become rows: a frequent key takes many tasks. A task
    holds the rows of one section at once, not those of a pair.
    """
    keys, section = ["category", *also], list(dict.fromkeys(["section_key", *also]))
    sections = sections.drop("category")
    own = [c for c in sections.columns if c not in section]
    listed = [c for c in checks.columns if c not in keys]
    left = _exploded(
        _blocks(sections, section, "_own"),
        R.SECTION_CHECK_CATEGORIES, "section_key", "category",
    )
    kept = list(dict.fromkeys([*keys, "section_key"]))
    pairs = left.join(_blocks(checks, keys, "_listed"), keys).repartition(
        *kept, "_own_block", "_listed_block"
    )
    rows = pairs.select(*kept, "_listed", F.explode("_own").alias("_own"))
    # One generated stage would hold all rows of a pair of blocks, a million, at
    # once. Its end after the first list leaves a section's checks; no partition
    # is merged.
    rows = rows.coalesce(1 << 30).select(*kept, "_own", F.explode("_listed").alias("_listed"))
    return rows.select(*kept, *_fields(own, "_own"), *_fields(listed, "_listed"))


def section_framework(sections: DataFrame, framework: DataFrame) -> DataFrame:
    """Framework sections behind each retrieval section."""
    listed = framework.select(
        "industry_type", F.explode("analysis_sections").alias("s")
    ).select("industry_type", F.col("s.section_key").alias("framework_section"), "s.description")
    return _exploded(
        sections, R.FRAMEWORK_SECTIONS, "section_key", "framework_section"
    ).join(listed, "framework_section")


def required_sections(frameworks: DataFrame) -> DataFrame:
    return frameworks.select(
        "industry_type",
        F.explode(
            F.filter("analysis_sections", lambda s: s["required"])
        ).alias("s"),
    ).select("industry_type", "s.section_key", "s.section_label")


def checks_in_category(frameworks: DataFrame, category: str) -> DataFrame:
    return frameworks.select(
        "industry_type",
        F.explode(
            F.filter("research_checks", lambda c: c["category"] == category)
        ).alias("c"),
    ).select("industry_type", "c.check_key")

