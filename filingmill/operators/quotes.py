"""Quotes in whole documents, through positional grams of words.

Texts and quotes are lower-cased and cut at blanks. A quote's inner words must
stand in the text whole, its first and last may be cut there. A gram is three
neighbouring words with their place; a quote of five words or more is looked up
by one of its inner grams, one with a digit if there is any, else the one with
most letters. It says where the quote would have to begin. Only there the words
of the text are compared with the quote, letter by letter. A quote of two to
four words uses the edge of its longest word, which has at least a quarter of
its letters, and a quote of one word its first letters inside long words. So
every quote meets a text by equality, and none is held against all chunks.

Of a text, each word moves once, as the hash of its gram (with the document)
and two numbers. A hash only proposes places, so equal hashes of different
grams cost a comparison and nothing else.

Defined results: quotes of ``min_length`` characters or fewer, and null quotes,
are not searched. Equal quotes of one document are searched once. Null texts
hold no quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingmill.functions import text as T
from filingmill.functions.rows import compute_once

DOC = ["company_id", "document_id"]
#: Most letters of an edge that have to be equal.
EDGE = 8


def _hash(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *[F.col(c).cast("string") for c in DOC], *parts)


def _gram(words: str, i: Column) -> Column:
    return _hash("t", *[F.get(F.col(words), i + k) for k in range(3)])


def _numbers(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _edges(min_length: int) -> tuple[int, int]:
    """Letters of the longest of four words, and of an edge of it."""
    longest = -(-(min_length - 2) // 4)
    return longest, min(EDGE, longest)


def _text_grams(chunks: DataFrame, min_length: int) -> DataFrame:
    """gram, chunk and place of all chunks; edges of words that are long enough."""
    words, n = F.col("words"), F.size("words")
    longest, edge = _edges(min_length)
    at = lambda i, key: F.struct(i.cast("int").alias("place"), key.alias("gram"))
    triples = F.transform(_numbers(F.lit(0), n - 3), lambda i: at(i, _gram("words", i)))
    long = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.length(x["w"]) >= longest
    )
    edges = F.flatten(F.transform("long", lambda x: F.array(
        at(x["i"], _hash("p", x["w"].substr(F.lit(1), F.lit(edge)))),
        at(x["i"], _hash("s", x["w"].substr(F.length(x["w"]) - edge + 1, F.lit(edge)))),
    )))
    inside = F.flatten(F.transform(
        F.filter("long", lambda x: F.length(x["w"]) > min_length),
        lambda x: F.array_distinct(F.transform(
            _numbers(F.lit(1), F.length(x["w"]) - edge + 1),
            lambda j: at(x["i"], _hash("c", x["w"].substr(j, F.lit(edge)))),
        )),
    ))
    rows = compute_once(
        chunks.where("content IS NOT NULL").select(*DOC, "chunk_index", "content"), words=F.split(F.lower("content"), " ", -1)
    ).withColumn("long", long)
    return rows.select("chunk_index", F.explode(F.concat(triples, edges, inside)).alias("g")).select(
        "g.gram", "chunk_index", "g.place"
    )


def _quote_grams(asked: DataFrame, min_length: int) -> DataFrame:
    """Quotes with the gram they are looked up by, and its place in the quote."""
    words, n, part = F.col("words"), F.size("words"), F.col("part")
    edge = _edges(min_length)[1]

    def worth(i: Column) -> Column:
        three = F.concat(*[F.get(words, i + k) for k in range(3)])
        return F.struct(three.rlike("[0-9]").alias("digit"), F.length(three).alias("n"), (-i).alias("i"))

    triple = -F.array_max(F.transform(_numbers(F.lit(1), n - 4), worth))["i"]
    longest = -F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))["i"]
    word = F.get(words, part)
    gram = (
        F.when(n >= 5, _gram("words", part))
        .when(n == 1, _hash("c", word.substr(1, edge)))
        .when(part == 0, _hash("s", word.substr(F.length(word) - edge + 1, F.lit(edge))))
        .otherwise(_hash("p", word.substr(1, edge)))
    )
    rows = compute_once(asked, words=F.split("needle", " ", -1))
    rows = compute_once(rows, part=F.when(n >= 5, triple).otherwise(longest).cast("int"))
    return compute_once(rows, gram=gram).select(*DOC, "needle", "part", "gram")


def quote_places(quotes: DataFrame, chunks: DataFrame, min_length: int = 40) -> DataFrame:
    """Chunks of each quote's own document that hold it.

    ``quotes`` has the document and ``supporting_quote``. Returns the document,
    ``needle`` (the quote in lower case) and chunk_index, one row per chunk.
    """
    if min_length < 2 * EDGE:
        raise ValueError(f"min_length below {2 * EDGE}")
    asked = quotes.where(F.length(T.trim_space(F.col("supporting_quote"))) > min_length).select(
        *DOC, F.lower("supporting_quote").alias("needle")
    )
    # Equal quotes have equal grams, so they meet where their gram is looked up.
    asked = _quote_grams(asked, min_length).repartition("gram").distinct()
    met = _text_grams(chunks, min_length).join(asked, "gram").select(
        *DOC, "chunk_index", "needle", (F.col("place") - F.col("part")).alias("start")
    ).where("start >= 0")
    place = [*DOC, "chunk_index"]
    texts = chunks.select(*place, "content").repartition(*place).select(
        *place, F.split(F.lower("content"), " ", -1).alias("text_words")
    )
    words = F.split("needle", " ", -1)
    there = F.array_join(F.slice("text_words", F.col("start") + 1, F.size(words)), " ")
    cut = F.length(F.get("text_words", F.col("start"))) - F.length(F.get(words, F.lit(0)))
    same = F.when(F.size(words) == 1, F.contains(there, F.col("needle"))).otherwise(
        (cut >= 0) & (there.substr(cut + 1, F.length("needle")) == F.col("needle"))
    )
    # Dealt by chunk, as the join needs it, so that no place is moved again.
    return met.repartition(*place).join(texts, place).where(same).select(*DOC, "needle", "chunk_index").distinct()
