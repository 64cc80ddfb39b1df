"""Hard negatives against plain loops, with odd vectors and small cells."""

import math
import random

import numpy as np
import pytest

from filingmill.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, id string, score int, anchor int"


def brute(rows):
    fit = []
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (key, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))
        if row not in fit:
            fit.append(row)
    out = []
    for key, label, vector in fit:
        if key % 50:
            continue
        scored = {(i, own, sum(x * y for x, y in zip(vector, v))) for i, own, v in fit if i != key}
        order = sorted(scored, key=lambda r: (-r[2], r[0]))
        alike = list(dict.fromkeys((i, s) for i, own, s in order if own == label))[:5]
        for positive, score in alike:
            inside = list(dict.fromkeys(
                (i, s) for i, own, s in order if own != label and 50 * score <= 100 * s <= 95 * score
            ))
            out += [(key, positive, n + 1, i, score, s) for n, (i, s) in enumerate(inside[:3])]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, hardneg.hard_negatives(frame).collect()))


def vectors(count, dims, seed, labels=3, spread=0.3):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(dims)]
    return [
        (i, rng.randrange(labels), [c + rng.gauss(0, spread) for c in centre]) for i in range(count)
    ]


@pytest.mark.parametrize("dims", [1, 7, 24])
def test_against_plain_loops(spark, monkeypatch, dims):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hardneg, "GROUP_ANCHORS", 2)
    rows = vectors(260, dims, dims)
    assert mined(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    rows = vectors(120, 9, 4)
    nan, inf = float("nan"), float("inf")
    same = rows[60][2]
    rows += [
        (200, None, same), (None, 1, same), (201, 1, None), (202, 1, [nan] * 9), (203, 1, [inf, *same[1:]]),
        (204, 1, [None, *same[1:]]), (250, 1, []), (205, 2, []), (206, 1, [0.0] * 9), (300, 2, same[:4]),
        # Ties, rows repeated, keys shared, and a hot vector.
        *[(400 + i, i % 3, same) for i in range(60)], rows[60], rows[50], rows[50], (50, 0, same), (60, 1, rows[3][2]),
    ]
    assert mined(spark, rows) == brute(rows) != []


def test_huge_components_and_empty_table(spark):
    rows = vectors(60, 4, 9)
    assert mined(spark, [*rows, (100, 1, [1e37, 0.0, 0.0, 0.0])]) == brute(rows)
    assert mined(spark, []) == []


def test_cells_are_not_broadcast(spark, monkeypatch):
    """Copies of anchors, one per slot, never gather in the driver, however small their file."""
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 50)
    seen, cells = [], hardneg._cells
    monkeypatch.setattr(hardneg, "_cells", lambda *sides: seen.append(cells(*sides)) or seen[-1])
    rows = vectors(200, 5, 2)
    assert mined(spark, rows) == brute(rows)
    assert len(seen) == 2
    for frame in seen:
        assert frame.count() >= 4 and "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_sums_beyond_floats():
    """Scores that floats would round are summed as integers."""
    rng = np.random.default_rng(3)
    cells = rng.integers(-(1 << 28), 1 << 28, (6, 500))
    cells[:, :250] //= 1 << 20
    for held in (cells, cells[:, :250]):
        ids = np.arange(held.shape[1])
        block = hardneg.Block(ids, np.zeros_like(ids), np.ascontiguousarray(held), 6)
        for anchor in (cells[:, 3], cells[:, 400]):
            found, scores = block.scan(anchor, ids, lambda rows, least, most: np.ones(len(rows), dtype=bool))
            assert (found == ids).all() and (scores == anchor @ held).all()


@pytest.mark.parametrize("top", [0, 100, 127, 128, 1 << 15, 1 << 31, (1 << 62)])
def test_packed_integers(top):
    values = np.array([0, top, -top, 5], dtype=np.int64)
    assert (hardneg.unpacked(hardneg.packed(values)) == values).all()
    assert len(hardneg.unpacked(hardneg.packed(values[:0]))) == 0


def test_windows_keep_what_may_be_among_the_best():
    rng = np.random.default_rng(7)
    for gap in (0, 3, 30):
        for _ in range(60):
            low = rng.integers(0, 60, 4)
            high = low + rng.integers(0, 25, 4)
            score = rng.integers(-20, 100, 80)
            least = score - rng.integers(0, gap + 1, 1)
            kept = hardneg.window_rule(low, high, 2)(np.arange(80), least, least + gap)
            for a, b in zip(low, high):
                inside = np.flatnonzero((score >= a) & (score <= b))
                assert kept[inside[np.argsort(-score[inside])][:2]].all()
            if not gap:
                assert not kept[~((score[:, None] >= low) & (score[:, None] <= high)).any(axis=1)].any()


def test_scans_drop_rows_early():
    rng = np.random.default_rng(1)
    cells = rng.integers(-60, 60, (64, 4000))
    cells[:4] *= 40
    block = hardneg.Block(np.arange(4000).tobytes(), np.zeros(4000, dtype=np.int64).tobytes(), cells.tobytes(), 64)
    seen = []

    def keep(rows, least, most):
        seen.append(len(rows))
        return hardneg.best_rule(5)(rows, least, most)

    found, scores = block.scan(cells[:, 0], np.arange(4000), keep)
    exact = cells[:, 0] @ cells
    assert set(np.argsort(-exact)[:5]) <= set(found)
    assert (exact[found] == scores).all()
    assert seen[1] < 400
