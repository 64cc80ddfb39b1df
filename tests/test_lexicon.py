"""The inverted index against plain string search."""

import random
import re

import numpy as np

from filingmill.operators import lexicon, retrieve
from filingmill.operators import points as P

CHUNK = "company_id string, document_id string, chunk_index int, page_start int, page_end int, content string"
WORDS = ["net", "debt", "netdebt", "of", "the", "x", "größe", "50%", "year", "on", "a_b", "years", "7"]


def frame(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(8):
        for i in range(1, 5):
            lines = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ". -"]) for _ in range(rng.randrange(0, 9)))
                     for _ in range(rng.randrange(1, 8))]
            rows.append(("c", f"d{d}", i, i, i, "\n".join(lines)))
    rows += [("c", "d8", 1, 1, 1, ""), ("c", "d8", 2, 1, 1, None), ("c", "d8", 0, 1, 1, "net debt of the years on years")]
    return rows, spark.createDataFrame(rows, CHUNK)


def plain(text):
    return " ".join(re.sub(r"[^\w%₹]|_", " ", text.lower()).split())


def points(text, query, bonus):
    pieces = re.split("[^a-z0-9_]+", plain(text))
    hit = bonus if lexicon.normalised(query) in plain(text) else 0
    return hit + sum(min(8, pieces.count(t)) for t in lexicon.query_tokens(query))


def phrases(count, seed=5):
    rng = random.Random(seed)
    base = [*WORDS, "et", "de", "bt of", "ear", "rs", "öß"]
    return {f"s{i % 7}": [] for i in range(7)} | {
        f"s{i}": [" ".join(rng.choice(base) for _ in range(rng.randrange(1, 5))) for _ in range(count // 7 + 1)]
        for i in range(7)
    }


def test_every_unit_and_query(spark):
    rows, chunks = frame(spark)
    queries = phrases(163)
    units = retrieve.evidence_units(chunks).collect()
    want = {}
    for u in units:
        for section, listed in queries.items():
            for i, q in enumerate(listed):
                value = points(u.content, q, 60)
                if value:
                    digit = 2 if re.search(r"\d", u.content) else 0
                    want[u.document_id, u.chunk_index, u.line_start, u.size, section, i] = value + digit
    got = {
        (r.document_id, r.chunk_index, r.line_start, r.size, r.section_key, r.query_index): r.score
        for r in retrieve.lexical_scores(chunks, queries).collect()
    }
    assert got == want and len(want) > 5000


def test_chunk_points_across_lines(spark):
    rows, chunks = frame(spark)
    queries = phrases(60, seed=8)
    found = lexicon.chunk_hits(*lexicon.occurrences(chunks, queries), 18).collect()
    got = {(r.document_id, r.chunk_index, r.section_key, r.query_index): r.hit for r in found}
    want = {}
    for _, d, i, *_, text in rows:
        for section, listed in queries.items():
            for n, q in enumerate(listed):
                value = points(text, q, 18) if text and i > 0 else 0
                if value:
                    want[d, i, section, n] = value
    assert got == want


def test_a_stored_index_gives_the_same(spark, tmp_path):
    _, chunks = frame(spark)
    queries = phrases(20, seed=1)
    path = str(tmp_path)
    lexicon.write_index(chunks, path, buckets=8)
    index = lexicon.read_index(spark, path)
    words = spark.read.parquet(f"{path}/words")
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(retrieve.lexical_scores(chunks, queries, index, words)) == key(retrieve.lexical_scores(chunks, queries))
    assert key(retrieve.selected_units(chunks, queries, 5, index, words)) == key(retrieve.selected_units(chunks, queries, 5))


def test_no_queries(spark):
    _, chunks = frame(spark)
    assert retrieve.lexical_scores(chunks, {}).count() == 0
    assert retrieve.lexical_scores(chunks, {"s": ["", "..."]}).count() == 0
    assert retrieve.select_evidence(chunks, {"s": []}).count() == 0


def test_matched_words_are_broadcast_and_postings_stay(spark):
    chunks = spark.createDataFrame(
        [("c", f"d{i}", 1, "Revenue grew in the year.\nDebt fell by 12 % in the year.") for i in range(50)],
        "company_id string, document_id string, chunk_index int, content string",
    )
    rows, _ = lexicon.occurrences(chunks, {"s": ["the year", "debt"]})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    # Twice the token year and both words of the phrase, once debt as either.
    assert rows.count() == 50 * 8


def test_settings_keep_partitions_small(spark):
    conf = spark.conf.get
    assert conf("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "2m"
    assert int(conf("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 2000


def test_words_left_out_match_nothing(spark):
    """Postings of words that hold a query's word are all that a search needs."""
    queries = {"s": ["the thereof", "net debt", "x-ray year's end"], "t": ["was", "net % of"]}
    held = lexicon.held_words(queries)
    assert held == ["%", "debt", "end", "net", "of", "ray", "s", "the", "x", "year"]
    assert lexicon.held_words({"s": ["--"]}) is None
    assert lexicon.held_words({"s": [f"{a}q{b}" for a in "abcdefghi" for b in "jklmnopr"]}) is None
    chunks = spark.createDataFrame(
        [("c", "1", 1, "The net debt thereof\nwas washed ashore, 12% of it\nmid year ends"), ("c", "1", 2, "blank Zeile ohne Wort\nkoo"),
         ("c", "2", 1, "networks; other x_ray\nx-ray YEAR S ENDing _the_")],
        "company_id string, document_id string, chunk_index int, content string",
    )
    keys, _ = lexicon.query_tables(spark, queries)
    every = lexicon.postings(chunks)
    some = lexicon.postings(chunks, held)
    matched = {r.word for r in lexicon.matched_words(lexicon.distinct_words(chunks), keys, queries).collect()}
    assert {tuple(r) for r in every.collect() if r.word in matched} <= {tuple(r) for r in some.collect()}
    assert {r.word for r in some.select("word").collect()}.isdisjoint({"blank", "zeile", "koo", "mid", "it"})
    assert some.where("chunk_index = 2").count() == 0


def test_a_posting_has_a_row_per_element_not_per_phrase(spark):
    """Phrases that share a first word share its rows."""
    chunks = spark.createDataFrame(
        [("c", f"d{i}", 1, "the year of the debt") for i in range(20)],
        "company_id string, document_id string, chunk_index int, content string",
    )
    few, many = ({"s": [f"the {w}" for w in words]} for words in (["year"], [f"year{i}" for i in range(40)]))
    rows = {len(q["s"]): lexicon.occurrences(chunks, q)[0].count() for q in (few, many)}
    # Twice "the" of any phrase; "year" as a token and as the second word of the one.
    assert rows == {1: 20 * 4, 40: 20 * 2}


def test_points_on_arrays_are_those_on_rows(spark):
    """Chunks that go over batches, that come twice, and that have null keys."""
    rows, _ = frame(spark, seed=11)
    rows += [*rows[:9], ("c", None, 1, 1, 1, "net debt\nof the year 7"), (None, "d1", 1, 1, 1, "debt of the year, 50% net debt")]
    rows += [("c", "long", 1, 1, 1, "\n".join(r[-1] for r in rows if r[-1]))]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = phrases(60, seed=2) | {"twice": ["net net debt", "the 7 net", "netdebt", "of the year years on"]}
    found, refs = lexicon.occurrences(chunks, queries)
    none = chunks.where("false").selectExpr(*lexicon.CHUNK, *(f"0 AS {c}" for c in ("line_start", "size", "line_end", "digit", "ref")))
    key = lambda rows: sorted(map(str, rows.collect()))
    want = key(lexicon.unit_hits(found, refs, 60, none))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 50, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert key(lexicon.unit_hits(found, refs, 60)) == want and len(want) > 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_codes_tell_rows_apart():
    huge = np.array([0, 1 << 40, 0, 1 << 40, 5])
    code = P.coded(huge, np.array([-3, 1 << 30, -3, 0, -3]), huge)
    assert code[0] == code[2] and len(set(code.tolist())) == 4
    order, edges = P.grouped(code)
    assert sorted(np.diff([*edges, 5]).tolist()) == [1, 1, 1, 2]
    assert [len(x) for x in P.grouped(code[:0])] == [0, 0]
    rows, items = P.Lists([(1, 7), (3, 8), (1, 9)], 5).of(np.array([3, 0, 1, 1]))
    assert rows.tolist() == [0, 2, 2, 3, 3] and items.tolist() == [8, 7, 9, 7, 9]
