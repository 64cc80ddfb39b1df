"""An inverted index over chunks, and query hits found through it.

A posting is one word of a chunk: where it stands, and which evidence units
its line belongs to. Queries are a table. Only the different words of the
corpus are compared with them: a word meets a query's tokens by its pieces, the
first word of a phrase by a suffix, the last by a prefix, the middle ones as
they are, and a phrase of one word by any substring, all by equality of keys.
The words that match anything then pick their postings. A phrase of k words
is there where k consecutive places match its words, so any number of phrases
takes one pass, and text is neither carried nor read again.

A query without letters and digits has no hits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.functions.rows import compute_once
from filingmill.operators import points
from filingmill.rules.words import QUERY_STOP_WORDS
from filingmill.session import fixed_table, written

#: A unit's least length in characters.
MIN_UNIT = 24
#: The points of a digit in a unit.
DIGIT_SCORE = 2
#: How often a token counts in one unit or chunk.
MAX_TOKEN_COUNT = 8
#: Up to so many different words of all queries, texts are tried for any of them first.
FEW_WORDS = 64

DOC = ["company_id", "document_id"]
CHUNK = [*DOC, "chunk_index"]
UNIT = [*CHUNK, "line_start", "size", "line_end", "digit"]

# Bits of a line's mask: which units are long enough, which hold a digit, and
# whether the line is the chunk's last one.
_ALONE, _WITH_NEXT, _WITH_LAST, _LAST_LINE = 1, 2, 4, 64


def normalised(query: str) -> str:
    """The search form of a query, as ``search_normalise`` gives it."""
    kept = [c if c.isalnum() or c in "%₹" else " " for c in query.lower()]
    return " ".join("".join(kept).split())


def query_tokens(query: str) -> list[str]:
    return [
        t for t in normalised(query).split(" ")
        if len(t) > 2 and t not in QUERY_STOP_WORDS
    ]


# -------------------------------------------------------------------- postings


def line_marks(chunks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each chunk with ``masks``: one number per line about its units."""
    lines = F.transform(F.split("content", "\n"), lambda x: T.trim_space(x))
    facts = F.transform("lines", lambda x: F.struct(
        F.length(x).alias("n"), x.rlike(r"\d").alias("digit")
    ))

    def mask(line: Column, i: Column) -> Column:
        def at(place: Column) -> tuple[Column, Column]:
            fact = F.get(F.col("facts"), place)
            return F.coalesce(fact["n"], F.lit(0)), F.coalesce(fact["digit"], F.lit(False))

        (n, digit), (n_next, d_next), (n_last, d_last) = at(i), at(i + 1), at(i - 1)
        blank = lambda a, b: ((a > 0) & (b > 0)).cast("int")
        bit = lambda test, value: F.when(test, value).otherwise(0)
        return (
            bit(n >= MIN_UNIT, _ALONE)
            + bit(n + n_next + blank(n, n_next) >= MIN_UNIT, _WITH_NEXT)
            + bit((i > 0) & (n + n_last + blank(n, n_last) >= MIN_UNIT), _WITH_LAST)
            + bit(digit, 8 * _ALONE) + bit(digit | d_next, 8 * _WITH_NEXT) + bit(digit | d_last, 8 * _WITH_LAST)
            + bit(i == F.size("facts") - 1, _LAST_LINE)
        )

    rows = compute_once(chunks.where(F.col("chunk_index") > 0).select(*keep, "content"), lines=lines)
    rows = compute_once(rows, facts=facts)
    return compute_once(rows, masks=F.transform("facts", mask)).select(*keep, "content", "masks")


def postings(chunks: DataFrame, holding: Sequence[str] | None = None) -> DataFrame:
    """word, chunk, line, place in the chunk and the line's mask.

    Words that hold none of the strings ``holding`` are left out, if given.
    """
    has = lambda text: F.lit(True) if holding is None else T.contains_any(text, holding)
    # A filter would work out the lower case for each string again.
    chunks = compute_once(chunks.select(*CHUNK, "content"), lower=F.lower("content")).where(has(F.col("lower")))
    clean = F.split(F.regexp_replace("lower", r"[^\p{L}\p{N}%₹\n]+", " "), "\n")
    rows = compute_once(line_marks(chunks, [*CHUNK, "lower"]), clean=F.transform(clean, lambda x: F.trim(x))).drop("lower")
    # Words before each line: its words are one more than its blanks.
    sizes = F.transform("clean", lambda x: F.when(x == "", 0).otherwise(
        F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    ))
    before = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    rows = compute_once(rows, before=before)
    lines = rows.select(*CHUNK, F.posexplode(F.arrays_zip("clean", "masks", "before")).alias("i", "l")).where(
        (F.col("l.clean") != "") & has(F.col("l.clean"))
    ).select(*CHUNK, (F.col("i") + 1).alias("line"), "l.clean", F.col("l.masks").alias("mask"), "l.before")
    words = lines.select(*CHUNK, "line", "mask", "before", F.posexplode(F.split("clean", " ")).alias("p", "word"))
    return words.where(has(F.col("word"))).select(
        *CHUNK, "word", "line", "mask", (F.col("before") + F.col("p")).alias("place")
    )


def distinct_words(chunks: DataFrame) -> DataFrame:
    """The different words of all chunks."""
    clean = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}%₹]+", " ")
    rows = chunks.where(F.col("chunk_index") > 0).select(F.explode(F.split(clean, " ")).alias("word"))
    return rows.where("word <> ''").distinct()


def write_index(chunks: DataFrame, path: str, buckets: int = 256) -> None:
    """Store the postings by buckets of words, and the words of each bucket."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    rows = postings(chunks).withColumn("bucket", bucket)
    # A frequent word may take several tasks, so that none is too large.
    rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*CHUNK), F.lit(4)))
    rows.sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = chunks.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/words")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings of a stored index; a filter on ``bucket`` prunes files."""
    return spark.read.parquet(f"{path}/postings")


# --------------------------------------------------------------------- queries


def held_words(queries: Mapping[str, Sequence[str]]) -> list[str] | None:
    """Strings one of which each word that matches a query holds, if they are few.

    Whole words, edges, pieces and substrings all hold the query's word.
    """
    words = {w for listed in queries.values() for q in listed for w in normalised(q).split()}
    words = {w for w in words if not any(o != w and o in w for o in words)}
    return sorted(words) if 0 < len(words) <= FEW_WORDS else None


def query_tables(spark: SparkSession, queries: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """What words are compared with, and the queries of each token and phrase.

    Keys are kind, key, part and their number, the element: kinds are ``w``
    token, ``e`` equal word, ``p`` prefix, ``s`` suffix, ``c`` substring; a
    token has the part -1. Phrases share the elements that they have in common.
    The second table has ref, section_key, query_index, n_words and elements; a
    token has no words.
    """
    numbers: dict[tuple, int] = {}
    keys: dict[tuple, int] = {}
    refs: list[tuple] = []
    for section, listed in queries.items():
        for index, query in enumerate(listed):
            for token in query_tokens(query):
                ref = numbers.setdefault(("w", token), len(numbers))
                refs.append((ref, section, index, 0, [keys.setdefault(("w", token, -1), len(keys))]))
            phrase = normalised(query)
            words = phrase.split()
            if not words:
                continue
            ref = numbers.setdefault(("p", phrase), len(numbers))
            kinds = ["c"] if len(words) == 1 else ["s", *"e" * (len(words) - 2), "p"]
            refs.append((ref, section, index, len(words), [
                keys.setdefault((kind, word, part), len(keys)) for part, (kind, word) in enumerate(zip(kinds, words))
            ]))
    return (
        fixed_table(spark, ["kind", "key", "part", "element"], [(*k, n) for k, n in keys.items()] or [("", "", 0, -9)]),
        fixed_table(spark, ["ref", "section_key", "query_index", "n_words", "elements"], refs or [(-9, "", 0, 0, [-9])]),
    )


def matched_words(words: DataFrame, keys: DataFrame, queries: Mapping[str, Sequence[str]]) -> DataFrame:
    """word, element, part and times of the words that match a query."""
    listed = [normalised(q).split() for group in queries.values() for q in group]
    short = lambda words: min(map(len, words), default=1)
    first = short(w[0] for w in listed if len(w) > 1)
    last = short(w[-1] for w in listed if len(w) > 1)
    inside = short(w[0] for w in listed if len(w) == 1)
    word, key, size = F.col("word"), F.col("key"), F.length("word")
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("block"))
    pieces = F.transform(F.split(word, "[^a-z0-9_]+"), lambda x: one("w", x))
    grams = F.transform(
        F.array_distinct(F.transform(F.sequence(F.lit(1), size - inside + 1), lambda i: word.substr(i, F.lit(inside)))),
        lambda x: one("c", x),
    )
    every = F.concat(
        F.array(one("e", word), one("s", word.substr(-first, first)), one("p", word.substr(1, last))),
        F.when(word.rlike("^[a-z0-9_]+$"), F.array(one("w", word))).otherwise(pieces),
        F.when(size >= inside, grams).otherwise(F.array().cast("array<struct<kind:string,block:string>>")),
    )
    # Words and keys meet at a block: their shortest edge or piece.
    blocks = keys.withColumn("block", F.expr(
        f"CASE kind WHEN 's' THEN right(key, {first}) WHEN 'p' THEN left(key, {last}) "
        f"WHEN 'c' THEN left(key, {inside}) ELSE key END"
    ))
    rows = words.select("word", F.explode(every).alias("k")).select("word", "k.kind", "k.block")
    fits = (
        F.when(F.col("kind") == "s", F.endswith(word, key)).when(F.col("kind") == "p", F.startswith(word, key))
        .when(F.col("kind") == "c", F.contains(word, key)).otherwise(True)
    )
    return rows.join(blocks, ["kind", "block"]).where(fits).groupBy("word", "element", "part").agg(
        F.count(F.lit(1)).cast("int").alias("times")
    )


def occurrences(
    chunks: DataFrame, queries: Mapping[str, Sequence[str]],
    index: DataFrame | None = None, words: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Postings of words that match a query, and the queries of the refs.

    A posting has a row for each element that it matches, not for each phrase
    with that element. ``start`` is the line of a token, and where its phrase
    would begin of a phrase's word. ``index`` and ``words`` are a stored index
    of the chunks.
    """
    keys, refs = query_tables(chunks.sparkSession, queries)
    holding = held_words(queries)
    if index is None and words is None and holding is not None:
        # One pass over the texts: postings that may match are few and kept.
        index = written(postings(chunks, holding))
        words = index.select("word").distinct()
    # Few words match. A table of known size is broadcast, so postings stay
    # where they were made and only those that match are moved.
    found = written(matched_words(distinct_words(chunks) if words is None else words, keys, queries))
    rows = (postings(chunks) if index is None else index).join(found, "word")
    start = F.when(F.col("part") < 0, F.col("line")).otherwise(F.col("place") - F.col("part"))
    return rows.select(*CHUNK, "element", start.alias("start"), "times", "line", "mask"), refs


def _of_refs(found: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each token or phrase of the rows' elements."""
    uses = {(e, r.ref, r.n_words) for r in refs.collect() for e in r.elements or []}
    table = fixed_table(found.sparkSession, ["element", "ref", "n_words"], sorted(uses))
    return found.join(table, "element").drop("element")


def _met(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tokens per line, and phrases all of whose words are there.

    All results are numbers, the first line with its mask and ``keep`` too, so
    that rows are hashed and not sorted.
    """
    first = F.col("first")
    met = rows.groupBy(*CHUNK, "ref", "n_words", "start").agg(
        F.sum("times").cast("int").alias("n"), F.min(F.col("line").cast("bigint") * 128 + F.col("mask")).alias("first"),
        F.max("line").alias("last"), *[F.max(c).alias(c) for c in keep],
    ).where("n_words = 0 OR n = n_words")
    return met.withColumn("first", F.struct(
        F.floor(first / 128).cast("int").alias("line"), (first % 128).cast("int").alias("mask")
    ))


def _by_query(met: DataFrame, refs: DataFrame, by: list[str], bonus: int) -> DataFrame:
    """Points of each query: tokens counted up to the cap, phrases once."""
    scored = met.groupBy(*by, "ref", "n_words").agg(F.sum("n").alias("n")).select(
        *by, "ref", F.when(F.col("n_words") == 0, F.least("n", F.lit(MAX_TOKEN_COUNT))).otherwise(bonus).alias("points")
    )
    return scored.join(refs.select("ref", "section_key", "query_index"), "ref").groupBy(*by, "section_key", "query_index").agg(
        F.sum("points").cast("int").alias("hit")
    )


def units_of(line: Column, mask: Column) -> Column:
    """The units of a line: alone, with the next and with the last line."""
    def unit(bit: int, start: Column, size: int, end: Column) -> Column:
        return F.when(mask.bitwiseAND(bit) > 0, F.struct(
            start.cast("int").alias("line_start"), F.lit(size).alias("size"), end.cast("int").alias("line_end"),
            F.when(mask.bitwiseAND(8 * bit) > 0, DIGIT_SCORE).otherwise(0).alias("digit"),
        ))

    after = F.when(mask.bitwiseAND(_LAST_LINE) > 0, line).otherwise(line + 1)
    return F.array_compact(F.array(
        unit(_ALONE, line, 1, line), unit(_WITH_NEXT, line, 2, after), unit(_WITH_LAST, line - 1, 2, line),
    ))


def _unit_points(found: DataFrame, refs: DataFrame, bonus: int, also: Mapping[str, Column]) -> DataFrame:
    """``unit_hits`` of found rows alone, without rows for each ref."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    counts = points.Points(refs.collect(), bonus, MAX_TOKEN_COUNT, DIGIT_SCORE)
    rows = found.repartition(*DOC).sortWithinPartitions(*CHUNK)
    units = rows.select(*CHUNK, "element", "start", "times", "line", "mask").mapInArrow(
        lambda batches: points.scored(counts, len(CHUNK), batches, [*UNIT, "hits"]),
        ", ".join(f"{c} {kinds.get(c, 'int')}" for c in UNIT) + ", hits array<bigint>",
    )
    asked, number = counts.asked or [("", 0)], F.shiftright("h", 32).cast("int")
    sections, indexes = (F.array(*[F.lit(x) for x in column]) for column in zip(*asked))
    return units.withColumns(also).select(*UNIT, *also, F.explode("hits").alias("h")).select(
        *UNIT, *also, F.get(sections, number).alias("section_key"), F.get(indexes, number).alias("query_index"),
        F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("hit"),
    )


def unit_hits(
    found: DataFrame, refs: DataFrame, bonus: int, extra: DataFrame | None = None, **also: Column
) -> DataFrame:
    """Points of each unit and query with a hit, without the digit points.

    ``extra`` are units that get no points: UNIT columns and a ref. ``also`` are
    columns made of a unit, without extra units. Rows are dealt by document once.
    """
    if extra is None:
        return _unit_points(found, refs, bonus, also)
    found = _of_refs(found, refs)
    line, mask = F.col("first.line"), F.col("first.mask")
    around = units_of(line, mask)
    both = F.filter(around, lambda u: (u["line_start"] == line) & (u["size"] == 2))
    units = F.when(F.col("last") == line, around).when(F.col("last") == line + 1, both)
    code, begin = F.col("unit"), F.floor(F.col("unit") / 16).cast("int")
    given = F.struct(
        begin.alias("line_start"), (F.floor(code / 2) % 2 + 1).cast("int").alias("size"),
        (begin + F.floor(code / 4) % 4).cast("int").alias("line_end"),
        (code % 2 * DIGIT_SCORE).cast("int").alias("digit"),
    )
    units = F.when(code.isNotNull(), F.array(given)).otherwise(units)
    more = extra.select(
        *CHUNK, "ref", F.lit(0).alias("n_words"), (F.col("line_start") * 2 + F.col("size")).alias("start"),
        F.lit(0).alias("times"), F.col("line_start").alias("line"), F.lit(0).alias("mask"),
        (
            F.col("line_start").cast("bigint") * 16 + (F.col("line_end") - F.col("line_start")) * 4
            + (F.col("size") - 1) * 2 + (F.col("digit") > 0).cast("int")
        ).alias("unit"),
    )
    found = found.unionByName(more, allowMissingColumns=True)
    met = _met(found.repartition(*DOC), ["unit"]).select(*CHUNK, "ref", "n_words", "n", F.explode(units).alias("u"))
    return _by_query(met.select(*CHUNK, "u.*", "ref", "n_words", "n"), refs, UNIT, bonus)


def chunk_hits(found: DataFrame, refs: DataFrame, bonus: int) -> DataFrame:
    """Points of each chunk and query with a hit."""
    return _by_query(_met(_of_refs(found, refs).repartition(*DOC)), refs, CHUNK, bonus)


def leading_units(chunks: DataFrame, per_chunk: int) -> DataFrame:
    """The first units with a digit of each chunk, up to ``per_chunk`` ids.

    The last line gives its unit twice, with one id; both rows are returned.
    """
    line = lambda i: (i + 1).cast("int")
    units = F.flatten(F.transform("masks", lambda m, i: F.filter(
        units_of(line(i), m), lambda u: (u["line_start"] == line(i)) & (u["digit"] > 0)
    )))
    spans = F.transform("units", lambda u: F.struct(u["line_start"], u["line_end"]))
    chunks = chunks.where(F.col("content").rlike(r"\d"))
    rows = compute_once(line_marks(chunks, CHUNK).drop("content"), units=units).where(F.size("units") > 0)
    rows = rows.withColumn("first", F.slice(F.array_distinct(spans), 1, per_chunk))
    kept = F.filter("units", lambda u: F.array_contains("first", F.struct(u["line_start"], u["line_end"])))
    return rows.select(*CHUNK, F.explode(kept).alias("u")).select(*CHUNK, "u.*")
