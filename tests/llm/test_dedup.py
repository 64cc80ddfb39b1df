"""Exact dedup and near-duplicates against brute force, with odd rows."""

import hashlib
import random
import re

import pytest

from brute import brute_components, shingles
from filingmill.llm import exact, neardup
from filingmill.llm.words import shingle_sets

DOCS = "doc_id long, text string, digest string, kept string"


def squeezed(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


ODD = [
    (3, "a  b"), (1, "a\tb"), (7, "a b"), (2, None), (9, ""), (4, " "), (5, "\n"),
    (6, "x" * 300_000), (8, "x" * 300_000 + " "), (None, "a b"), (1, "a\tb"), (11, "ñ  "),
]


def test_exact_against_brute_force(spark):
    rows = exact.dedup(table(spark, ODD), exact.new_index(spark)).collect()
    groups = {}
    for key, text in ODD:
        groups.setdefault(squeezed(text), []).append(key)
    want = []
    for key, text in ODD:
        own = groups[squeezed(text)]
        keep = min(k for k in own if k is not None)
        sha = hashlib.sha256(squeezed(text).encode()).digest()
        want.append((key, keep, len(own), key == keep, sha))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_index_persists_and_first_copies(spark):
    index = exact.new_index(spark)
    exact.dedup(table(spark, [(10, "old text"), (12, "other")]), index).collect()
    docs = table(spark, [(1, "old  text"), (2, "new"), (3, "new"), (2, "new"), (2, "twice used key")])
    rows = exact.dedup(docs, index)
    got = {(r.doc_id, r.keep_id, r.kept) for r in rows.collect()}
    assert got == {(1, 10, False), (2, 2, True), (3, 2, False)}
    left = exact.first_copies(docs, rows)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(2, "new"), (2, "twice used key")]


def test_exact_empty_table(spark):
    docs = table(spark, [])
    rows = exact.dedup(docs, exact.new_index(spark))
    assert rows.collect() == [] and exact.first_copies(docs, rows).collect() == []


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Chains, a large group of edited copies, shared passages, short texts."""
    rng = random.Random(4)
    rows, base = [], [f"b{rng.randrange(500)}" for _ in range(150)]
    rows += [(i, edited(rng, base, rng.randrange(7))) for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(25):
        chain[i * 4] = f"d{i}"
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one TWO"), (3005, "one two three")]
    rows += [(3006, "É a b c d e"), (3007, "é a b c d e"), (3008, "w " * 40_000), (3009, "w " * 39_000)]
    return rows


def test_neardup_against_brute_force(spark, copies):
    rows = neardup.near_duplicates(table(spark, copies), percent=85).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got == brute_components(copies, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_bands_follow_the_limit():
    for percent in range(5, 100):
        rows = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (neardup.REGISTERS // rows) <= 1e-5
    assert neardup.band_rows(85) == 7


def test_neardup_at_half(spark):
    rng = random.Random(9)
    rows = []
    for i in range(100):
        words = [f"v{rng.getrandbits(60)}" for _ in range(154)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:104] + [f"v{rng.getrandbits(60)}" for _ in range(48)]))]
    got = neardup.near_duplicates(table(spark, rows), percent=50).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 50)


def test_neardup_large_buckets(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    rows = neardup.near_duplicates(table(spark, copies), percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(copies, 80)


def with_common_lines(count):
    """Edited copies of one text; every copy may hold some of six common lines."""
    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    base, lines, rows = new(150), [new(10) for _ in range(6)], []
    for i in range(count):
        words = list(base)
        for line in rng.sample(lines, rng.randrange(3)):
            at = rng.choice([0, 40, 80, 120, len(words)])
            words[at:at] = line
        rows.append((i, edited(rng, words, rng.randrange(4))))
    return rows


def test_neardup_pairs_grow_with_a_group_not_its_square(spark, monkeypatch):
    tried, plain = [], neardup._promising
    monkeypatch.setattr(
        neardup, "_promising", lambda pairs, *rest: tried.append(pairs.count()) or plain(pairs, *rest)
    )
    for count in (200, 800):
        rows = with_common_lines(count)
        got = neardup.near_duplicates(table(spark, rows), percent=85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)
    small, large = sum(tried[:2]), sum(tried[2:])
    assert large < 8 * small, (tried, "16 times as many pairs would be the square")


def test_neardup_repeats_nulls_and_empty(spark):
    text = "the quick brown fox jumps over it"
    docs = table(spark, [(5, text), (5, text), (2, text.upper()), (None, text), (8, "else " + "z y x w v u")])
    rows = neardup.near_duplicates(docs)
    got = sorted((repr(r.doc_id), r.component_id, r.kept) for r in rows.collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("8", 8, True), ("None", 2, False)]
    left = neardup.first_of_components(docs, rows)
    assert sorted(r.doc_id for r in left.collect()) == [2, 8] and left.columns == docs.columns
    assert neardup.near_duplicates(table(spark, [])).collect() == []


def test_shingle_sets_match_plain_sets():
    texts = ["a b c d e f a b c d e", "", "A\x0bb", "x", "é É " * 9]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
