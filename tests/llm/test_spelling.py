"""Spelling variants against plain loops, on small trees and odd words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filingmill.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string"


def brute_words(rows, least=6, least_n=5, every=199):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if code % every == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= least_n}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(words):
    partners = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(partners[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def grouped(spark, rows, **options):
    frame = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], SCHEMA)
    return sorted(map(tuple, spelling.spelling_groups(frame, **options).collect()), key=lambda r: r[0])


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([
        word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:],
        word[:at] + rng.choice(letters) + word[at + 1:], word[:at] + word[at + 1:at + 2] + word[at:at + 1] + word[at + 2:],
    ])


def texts(seed, letters, count=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(count)]
    pool = base + [edited(rng, edited(rng, w, letters), letters) for w in base] + [edited(rng, w, letters) for w in base]
    rows = []
    for key in range(200):
        words = [rng.choice(pool[:1 + int(len(pool) * rng.random() ** 2)]) for _ in range(40)]
        rows.append((key, rng.choice([" ", ", ", "1", "\n", "’", "œ"]).join(words)))
    return rows


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aeÉéÿ×st"])
@pytest.mark.parametrize("sample", [40, 1 << 17])
def test_against_plain_loops(spark, monkeypatch, letters, sample):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 16)
    monkeypatch.setattr(spelling, "LEAF_POINTS", 4)
    monkeypatch.setattr(spelling, "DEAL_WORDS", 50)
    rows = texts(len(letters), letters)
    want = brute(brute_words(rows))
    assert grouped(spark, rows, sample=sample) == want
    assert any(form for _, form, *_ in want)


def test_roots_follow_chains(spark):
    # Each is one edit from the next.
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    rows = [(0, " ".join([w] * 5 ** (i + 1))) for i, w in enumerate(chain)]
    found = grouped(spark, rows, every=10**12)
    assert [r[2] for r in found] == [chain[4]] * 5
    assert found == brute(brute_words(rows, every=10**12))


def test_odd_rows(spark):
    long = "x" * 50_000
    rows = [(None, "Colour colour"), (1, None), (2, ""), (3, "1234 ... 中文"), (3, "colour colour colour")]
    rows += [(4, f"color {long} {long}y")] * 40 + [(5, "anagram nagaram colours")] * 6 + [(6, "ÀÉÎÕÜß àéîõüß")] * 5
    assert grouped(spark, rows) == brute(brute_words(rows))
    assert grouped(spark, []) == []


def test_every_run_of_some_documents_is_shortened(spark):
    rows = [(i, " ".join(f"word{'abcdefgh'[j]}ing" for j in range(8))) for i in range(300)]
    found = grouped(spark, rows, every=7)
    assert found == brute(brute_words(rows, every=7)) and len(found) > 20


def test_a_search_skips_boxes_but_no_near_word():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.7, (2000, 91)).astype(np.int16)
    counts[:, 30:] = 0
    tree = spelling.Tree(counts, 8)
    asking = counts[:200]
    met, visited = set(), 0
    for leaf, rows in tree.search(asking, 1, 1):
        met |= {(int(q), int(r)) for q in rows for r in tree.leaves[leaf]}
        visited += len(rows)
    gaps = asking[:, None, :].astype(int) - counts[None]
    want = {(int(q), int(r)) for q, r in zip(*np.nonzero((gaps.clip(0).sum(2) <= 1) & ((-gaps).clip(0).sum(2) <= 1)))}
    assert want <= met
    assert visited < 200 * len(tree.leaves) / 2
