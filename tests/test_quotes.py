"""Quotes in whole documents against plain string search."""

import random

import pytest

from filingmill.operators import quotes

CHUNK = "company_id string, document_id string, chunk_index int, content string"
QUOTE = "company_id string, document_id string, supporting_quote string"


def want(asked, chunks, min_length):
    out = set()
    for c, d, quote in asked:
        if quote is None or len(quote.strip()) <= min_length:
            continue
        for c2, d2, i, content in chunks:
            if (c, d) == (c2, d2) and content and quote.lower() in content.lower():
                out.add((d, quote.lower(), i))
    return sorted(out)


def found(spark, asked, chunks, min_length):
    rows = quotes.quote_places(
        spark.createDataFrame(asked, QUOTE), spark.createDataFrame(chunks, CHUNK), min_length
    ).collect()
    return sorted((r.document_id, r.needle, r.chunk_index) for r in rows)


@pytest.mark.parametrize("min_length", [16, 40])
def test_against_plain_search(spark, min_length):
    rng = random.Random(min_length)
    words = ["Net", "debt", "fell", "größe", "a", "", "of\nthe", "year", "x" * 30, "Internationalisation", "y" * 90, "50%"]
    chunks = [
        ("c", f"d{d}", i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))))
        for d in range(12) for i in range(6)
    ] + [("c", "d1", 99, None), ("c", "d1", 98, "")]
    asked = [("c", "d0", None), ("c", "d0", ""), ("c", "d0", " " * 60), ("c", "none", "z" * 60), ("c", "d2", "z" * 60)]
    for c, d, _, content in chunks:
        for _ in range(12):
            if content:
                start = rng.randrange(len(content))
                cut = content[start:start + rng.choice([min_length + 1, min_length + 9, 70, 200])]
                asked += [(c, d, cut), (c, d, cut.upper()), (c, f"d{rng.randrange(12)}", cut), (c, d, cut[:30] + "q" + cut[30:])]
    expected = want(asked, chunks, min_length)
    assert found(spark, asked, chunks, min_length) == expected and len(expected) > 300


def test_a_hot_sentence_and_empty_tables(spark):
    line = "The same disclaimer stands below every page of the report."
    chunks = [("c", "d", i, f"{line} {i}") for i in range(300)]
    assert len(found(spark, [("c", "d", line)] * 300, chunks, 40)) == 300
    assert found(spark, [], chunks, 40) == found(spark, [("c", "d", line)], [], 40) == []
    with pytest.raises(ValueError):
        quotes.quote_places(spark.createDataFrame([], QUOTE), spark.createDataFrame([], CHUNK), 10)


def test_a_word_of_a_text_moves_once_without_its_document(spark):
    chunks = [("c", "d", i, "Net debt of the group fell by 50% in the year") for i in range(10)]
    grams = quotes._text_grams(spark.createDataFrame(chunks, CHUNK), 40)
    assert dict(grams.dtypes) == {"gram": "bigint", "chunk_index": "int", "place": "int"}
    assert grams.count() <= 10 * 11


def test_quotes_of_few_words_and_equal_ids_of_other_companies(spark):
    long = "Internationalisation"
    chunks = [("a", "d", 0, f"x {long} {long}{long} y z"), ("b", "d", 0, f"pre{long} {long} of {long}s"), ("b", "d", 1, "no 7 b c d e")]
    asked = [("a", "d", f"{long} {long}"), ("b", "d", f"{long} {long} OF {long}"), ("b", "d", long * 2), ("a", "d", long * 2)]
    assert found(spark, asked, chunks, 36) == want(asked, chunks, 36) and len(want(asked, chunks, 36)) == 3
