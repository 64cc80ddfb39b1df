"""Lexical evidence retrieval: candidate units, scores, capped selection.

The selection walks queries in order, takes the best units of each, skips
repeats, and stops at a cap per chunk and a cap per section. A unit refused by
a cap stays refused, since caps only fill up. So the walk equals a chain of
``row_number`` filters over one ordering key, and each filter prunes before
its shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.functions.rows import compute_once, explode_rows
from filingmill.operators import lexicon
from filingmill.operators.lexicon import CHUNK, DOC
from filingmill.rules import research as R
from filingmill.session import fixed_table, stored

UNIT_BONUS = 60
CHUNK_BONUS = 18
BEST_PER_QUERY = 4
PER_CHUNK = 6
PER_SECTION = 32
CHUNKS_PER_QUERY = 2
CHUNKS_PER_SECTION = 8
MIN_UNITS = 12
MIN_CHUNKS = 2

# Refs of units without a hit: for every query, and once for every section.
_QUERIES, _SECTIONS = -1, -2


def section_queries(
    spark: SparkSession, queries: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """The query table: section_key, query_index, query."""
    source = R.SECTION_QUERIES if queries is None else queries
    rows = [
        (section, i, q)
        for section, listed in source.items()
        for i, q in enumerate(listed)
    ]
    return fixed_table(spark, ["section_key", "query_index", "query"], rows)


def evidence_units(chunks: DataFrame) -> DataFrame:
    """Each line of a chunk alone and with the next line.

    All lines of a chunk are in one row, so pairs are built in place and
    nothing is shuffled. The last line gives its unit twice, with one id.
    """
    lines = F.transform(F.split("content", "\n"), lambda x: T.trim_space(x))
    n = F.size("lines")

    def unit(i: Column, size: int) -> Column:
        picked = F.filter(F.slice("lines", i, size), lambda x: x != "")
        end = F.least(n, i + size - 1)
        return F.struct(
            i.alias("line_start"), end.alias("line_end"), F.lit(size).alias("size"),
            F.array_join(picked, " ").alias("content"),
        )

    units = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array(unit(i, 1), unit(i, 2)))
    )
    units = F.filter(units, lambda u: F.length(u["content"]) >= lexicon.MIN_UNIT)
    place = [*CHUNK, "page_start", "page_end"]
    rows = chunks.where(F.col("chunk_index") > 0).select(*place, "content")
    rows = compute_once(rows, lines=lines).select(*place, "lines")
    return explode_rows(rows, place, units, "u").select(*place, "u.*", unit_id().alias("unit_id"))


def unit_id(start: str = "u.line_start", end: str = "u.line_end") -> Column:
    """chunk:first line-last line"""
    return F.concat(F.col("chunk_index"), F.lit(":"), F.col(start), F.lit("-"), F.col(end))


def lexical_scores(
    chunks: DataFrame, queries: Mapping[str, Sequence[str]] = R.SECTION_QUERIES,
    index: DataFrame | None = None, words: DataFrame | None = None,
) -> DataFrame:
    """Unit scores per query that has a hit; the digit bonus is included.

    ``index`` and ``words`` are a stored index of the same chunks; without
    them, postings are made on the way.
    """
    found = lexicon.occurrences(chunks, queries, index, words)
    hits = lexicon.unit_hits(*found, UNIT_BONUS, unit_id=unit_id("line_start", "line_end"))
    return hits.select(
        *CHUNK, "line_start", "line_end", "size", "unit_id",
        "section_key", "query_index", (F.col("hit") + F.col("digit")).alias("score"),
    )


def _row_number(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window))


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return _row_number(rows, keys, order).where(F.col("_rn") <= n).drop("_rn")


def selected_units(
    chunks: DataFrame,
    queries: Mapping[str, Sequence[str]] = R.SECTION_QUERIES,
    limit: int = PER_SECTION,
    index: DataFrame | None = None,
    words: DataFrame | None = None,
) -> DataFrame:
    """Ids and places of the units of every evidence pack, without text.

    A digit gives every unit two points for every query, so units without any
    hit compete too, but few of them can win. Per document the first ``limit``
    digit units can fill a section (of a chunk the first six ids, the chunk's
    cap), because each earlier one ranks at least as high; for one query only
    the first four rows can be among its best four. Those meet the sections and
    the queries; no other unit without a hit is carried.

    Hits are dealt by document once; windows and groups below are on keys that
    start with the document.
    """
    place = ["chunk_index", "line_start", "size"]
    unit = [*place, "line_end", "digit"]
    scope = [*DOC, "section_key"]
    # The twin of a chunk's last line shares its id and is counted once.
    twin = (F.col("size") == 2) & (F.col("line_start") == F.col("line_end"))
    so_far = Window.partitionBy(*DOC).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leads = lexicon.leading_units(chunks, PER_CHUNK).withColumns({
        "units": F.sum((~twin).cast("int")).over(so_far), "rows": F.count(F.lit(1)).over(so_far),
    }).where(F.col("units") <= limit)
    # The first few stand for every query, all of them once for every section.
    refs = F.when(F.col("rows") <= BEST_PER_QUERY, F.array(F.lit(_QUERIES), F.lit(_SECTIONS))).otherwise(
        F.array(F.lit(_SECTIONS))
    )
    extra = leads.select(*CHUNK, "line_start", "size", "line_end", "digit", F.explode(refs).alias("ref"))
    asked = [(s, i) for s, listed in queries.items() for i in range(len(listed))]
    found, known = lexicon.occurrences(chunks, queries, index, words)
    known = known.unionByName(fixed_table(
        chunks.sparkSession, ["ref", "section_key", "query_index"],
        [(_QUERIES, s, i) for s, i in asked] + [(_SECTIONS, s, -1) for s, q in queries.items() if q] or [(-9, "", 0)],
    ), allowMissingColumns=True)
    rows = lexicon.unit_hits(found, known, UNIT_BONUS, extra)
    score = F.col("hit") + F.col("digit")
    ranked = _row_number(rows.withColumn("score", score), [*scope, "query_index"], [F.desc("score"), *place])
    # One number, so that rows are hashed below and not sorted.
    early = F.when(
        (F.col("_rn") <= BEST_PER_QUERY) & (F.col("query_index") >= 0),
        F.col("query_index") * (BEST_PER_QUERY + 1) + F.col("_rn"),
    )
    present = ranked.select(*scope, *unit, "hit", early.alias("early"))
    # Summed score: a unit gets its digit points once per query of a section.
    sizes = F.create_map(*[x for s, q in queries.items() for x in (F.lit(s), F.lit(len(q)))])
    total = F.col("hit_total") + F.col("digit") * F.try_element_at(sizes, F.col("section_key"))
    keyed = present.groupBy(*scope, *unit).agg(F.min("early").alias("early"), F.sum("hit").alias("hit_total")).select(
        *scope, *unit, unit_id("line_start", "line_end").alias("unit_id"),
        F.col("early").isNull().cast("int").alias("phase"),
        F.coalesce(F.floor(F.col("early") / (BEST_PER_QUERY + 1)).cast("int"), F.lit(0)).alias("step"),
        F.coalesce((F.col("early") % (BEST_PER_QUERY + 1)).cast("bigint"), -total).alias("rank"),
    )
    order = ["phase", "step", "rank", *place]
    # A twin has the same points and digit as the line alone, so it always ranks after it.
    chain = _first(keyed.where(~twin), [*scope, "chunk_index"], order, PER_CHUNK)
    chain = _first(chain, scope, order, limit)
    return chain.select(
        *scope, "unit_id", "chunk_index", "line_start", "line_end", "size"
    )


def select_evidence(
    chunks: DataFrame,
    queries: Mapping[str, Sequence[str]] = R.SECTION_QUERIES,
    limit: int = PER_SECTION,
) -> DataFrame:
    """The evidence pack of every section of every document.

    Units are ranked by id; the text of those that stay is read again from
    their chunk, which has one row per document and index.
    """
    picked = selected_units(chunks, queries, limit)
    source = chunks.select(*DOC, "chunk_index", "page_start", "page_end", "content")
    lines = F.slice(F.split("content", "\n"), F.col("line_start"), F.col("size"))
    lines = F.filter(F.transform(lines, T.trim_space), lambda x: x != "")
    return picked.join(source, [*DOC, "chunk_index"]).select(
        *DOC, "section_key", "unit_id", "chunk_index", "page_start",
        "page_end", "line_start", "line_end",
        F.array_join(lines, " ").alias("content"),
    )


def evidence_gate(
    packs: DataFrame,
    documents: DataFrame,
    sections: Sequence[str] = tuple(R.SECTIONS),
    min_units: int = MIN_UNITS,
    min_chunks: int = MIN_CHUNKS,
) -> DataFrame:
    """Is each section's pack sufficient? Empty packs count as rows too."""
    found = packs.groupBy(*DOC, "section_key").agg(
        F.count("*").alias("n_units"),
        F.count_distinct("chunk_index").alias("n_chunks"),
    )
    wanted = documents.select(
        *DOC,
        F.explode(F.array(*[F.lit(s) for s in sections])).alias("section_key"),
    )
    return (
        wanted.join(found, [*DOC, "section_key"], "left")
        .na.fill(0, ["n_units", "n_chunks"])
        .withColumn(
            "sufficient",
            (F.col("n_units") >= min_units)
            & (F.col("n_chunks") >= min_chunks),
        )
    )


def add_anchor_chunks(pack_chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Chunks of each pack plus the fixed anchor chunks of a section.

    ``anchors`` has document_id, section_key and chunk_index.
    """
    extra = anchors.join(
        pack_chunks.select(*DOC, "section_key").distinct(),
        ["document_id", "section_key"],
    )
    return pack_chunks.unionByName(
        extra.select(*pack_chunks.columns)
    ).distinct()


# ------------------------------------------------------------ chunk selection


def select_chunks(
    chunks: DataFrame,
    queries: Mapping[str, Sequence[str]] = R.SECTION_QUERIES,
    basis_sections: Sequence[str] = tuple(R.BASIS_SECTIONS),
    basis_queries: Sequence[str] = tuple(R.BASIS_QUERIES),
    limit: int = CHUNKS_PER_SECTION,
) -> DataFrame:
    """Best chunks per section: basis statements, queries, sums, neighbours."""
    content = chunks.where(F.col("chunk_index") > 0)
    scope = [*DOC, "section_key"]
    with_basis = dict(queries)
    with_basis["_basis"] = list(basis_queries)
    # Read five times below.
    hits = stored(lexicon.chunk_hits(*lexicon.occurrences(content, with_basis), CHUNK_BONUS))
    hits = hits.withColumnRenamed("hit", "score")
    sums = hits.groupBy(*scope, "chunk_index").agg(
        F.sum("score").cast("int").alias("total")
    )
    wanted = [s for s in queries if s in basis_sections]
    anchors = _row_number(
        sums.where(F.col("section_key") == "_basis"), DOC,
        [F.desc("total"), "chunk_index"],
    ).where(F.col("_rn") <= CHUNKS_PER_QUERY)
    keep = [*scope, "chunk_index", "phase", "step", "rank"]
    phase0 = anchors.select(
        *DOC,
        F.explode(
            F.array(*[F.lit(s) for s in wanted]).cast("array<string>")
        ).alias("section_key"),
        "chunk_index", F.lit(0).alias("phase"), F.lit(0).alias("step"),
        F.col("_rn").alias("rank"),
    )
    named = hits.where(F.col("section_key") != "_basis")
    best = _row_number(
        named, [*scope, "query_index"], [F.desc("score"), "chunk_index"]
    ).where(F.col("_rn") <= CHUNKS_PER_QUERY)
    phase1 = best.select(
        *scope, "chunk_index", F.lit(1).alias("phase"),
        F.col("query_index").alias("step"), F.col("_rn").alias("rank"),
    )
    phase2 = sums.where(F.col("section_key") != "_basis").select(
        *scope, "chunk_index", F.lit(2).alias("phase"),
        F.lit(0).alias("step"), (-F.col("total")).alias("rank"),
    )
    order = ["phase", "step", "rank", "chunk_index"]
    chain = phase0.unionByName(phase1).unionByName(phase2)
    chain = _first(chain, [*scope, "chunk_index"], order, 1)
    chain = _row_number(chain, scope, order).where(F.col("_rn") <= limit)
    chosen = chain.withColumnRenamed("_rn", "place")
    return chosen.select(*scope, "chunk_index", "place").unionByName(
        _neighbours(chosen, content, scope, limit)
    )


def _neighbours(
    chosen: DataFrame, content: DataFrame, scope: list[str], limit: int
) -> DataFrame:
    """Chunks next to the chosen ones, while a section is below its limit."""
    around = chosen.select(
        *scope, "place",
        F.explode(
            F.array(
                F.struct(
                    (F.col("chunk_index") - 1).alias("chunk_index"),
                    F.lit(0).alias("side"),
                ),
                F.struct(
                    (F.col("chunk_index") + 1).alias("chunk_index"),
                    F.lit(1).alias("side"),
                ),
            )
        ).alias("n"),
    ).select(*scope, "place", "n.chunk_index", "n.side")
    fresh = (
        around.join(
            content.select(*DOC, "chunk_index"), [*DOC, "chunk_index"],
            "left_semi",
        )
        .join(
            chosen.select(*scope, "chunk_index"), [*scope, "chunk_index"],
            "left_anti",
        )
    )
    fresh = _first(fresh, [*scope, "chunk_index"], ["place", "side"], 1)
    counts = chosen.groupBy(*scope).agg(F.count("*").alias("n_chosen"))
    numbered = _row_number(fresh, scope, ["place", "side"]).join(counts, scope)
    total = F.col("n_chosen") + F.col("_rn")
    return numbered.where(total <= limit).select(
        *scope, "chunk_index", total.cast("int").alias("place")
    )
