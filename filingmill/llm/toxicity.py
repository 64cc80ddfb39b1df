"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Units are words, lowered and without marks, so inserted marks change nothing;
runs of three or more single letters become one unit. The kernel of two units
sums over their common subsequences of three and four letters, with a decay for
each letter left out, so inserted letters only weaken a match. It is divided by
the length norms of both units. Unit edges are letters too.

Labels belong to documents, so sentences are learned as bags of units: the
most telling units of toxic documents are positives, units of clean documents
negatives, and rounds of fitting and choosing again settle on the units that
carry the label. The SVM lives in the space of ``LANDMARKS`` landmark units.
Its weight vector is a sum of landmark images, so it is stored as one table of
subsequence weights, and scoring a unit is a sum of table values, equal to
the sum over landmarks. A logistic model turns a document's unit scores (the
largest, the number of toxic ones, their share) into a probability.

Training takes at most ``SAMPLE`` documents per label on the driver, those with
the smallest hash. Scoring passes once over all documents and whole texts.

Defined results: null and empty texts have no units and get the score of a text
without toxic units. Rows with a null label or several labels are not learned
from. Repeated rows get equal scores. Extra columns are ignored. Without rows
of both labels training fails with a clear message.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.llm.common import batches_of, slices
from filingmill.llm.quality import held_out, sampled

SAMPLE = 600
LANDMARKS = 160
ROUNDS = 3
#: A unit counts as toxic above this SVM score.
CLEAR = 0.3
DECAY = 0.5
CUT = 0.5
#: Letters beyond the shortest span that a subsequence may stretch over.
SLACK = 2
_EDGE, _SPACE, _DROP = 31, 254, 255
#: Digits and signs that stand for letters: fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def _folds() -> np.ndarray:
    """Symbol of each character: a-z, four classes of other letters, space."""
    out = np.full(0x110000, _DROP, dtype=np.uint8)
    for code in range(0x10000):
        c = chr(code)
        low = LOOKALIKES.get(c, c.lower())[:1]
        if "a" <= low <= "z":
            out[code] = ord(low) - ord("a") + 1
        elif c.isspace():
            out[code] = _SPACE
        elif c.isalpha():
            out[code] = 27 + ord(low) % 4
    return out


_FOLD = _folds()
#: (offsets of the later letters, weight) for each shape of a subsequence.
SHAPES = [
    (tuple(itertools.accumulate(gaps)), DECAY ** (sum(gaps) - len(gaps)))
    for letters in (3, 4)
    for gaps in itertools.product(range(1, SLACK + 2), repeat=letters - 1)
    if sum(gaps) <= letters - 1 + SLACK
]
_SIZES = {3: 1 << 15, 4: 1 << 20}


class Units:
    """The units of many texts as one row of symbols with edges between."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-32-le", errors="surrogatepass") for t in texts]
        sizes = np.array([len(r) // 4 + 1 for r in raw], dtype=np.int64)
        code = np.frombuffer("\n".encode("utf-32-le").join([*raw, b""]), dtype=np.uint32)
        symbol = _FOLD[code]
        at = np.flatnonzero(symbol != _DROP)
        symbol = symbol[at]
        gap = symbol == _SPACE
        again = np.concatenate([[True], gap[:-1]]) & gap
        at, symbol, gap = at[~again], symbol[~again], gap[~again]
        # A run of single letters is one unit.
        ends = np.flatnonzero(gap)
        length = np.diff(ends, prepend=-1) - 1
        lone = np.concatenate([[False], length == 1, [False]])
        turns = np.flatnonzero(lone[1:] != lone[:-1])
        drop = np.zeros(len(symbol), dtype=bool)
        for first, last in zip(turns[::2], turns[1::2]):
            if last - first >= 3:
                inner = ends[first:last - 1]
                # A text's end is an edge always.
                drop[inner[code[at[inner]] != 10]] = True
        at, symbol, gap = at[~drop], symbol[~drop], gap[~drop]
        self.row = np.concatenate([[_EDGE], np.where(gap, _EDGE, symbol)]).astype(np.uint32)
        self.edges = np.flatnonzero(self.row == _EDGE)
        self.count = len(self.edges) - 1
        span = np.diff(self.edges)
        self.lengths = span - 1
        near = np.repeat(self.edges[1:], span) - np.arange(self.edges[-1])
        self.room = np.minimum(near, 255).astype(np.uint8)
        start = at[self.edges[:-1]] if self.count else np.zeros(0, dtype=np.int64)
        self.owner = np.searchsorted(np.cumsum(sizes), start, "right")
        self.texts = len(texts)

    def word(self, i: int) -> str:
        """The unit with one letter for each symbol; it has the same image."""
        own = self.row[self.edges[i] + 1:self.edges[i + 1]]
        return "".join(chr(96 + s) if s < 27 else "äåæç"[s - 27] for s in own)

    def norms(self) -> np.ndarray:
        """Kernel norm of a unit of this length without repeated subsequences."""
        total = np.zeros(self.count)
        for offsets, weight in SHAPES:
            total += np.maximum(self.lengths + 2 - offsets[-1], 0) * weight ** 2
        return np.sqrt(np.maximum(total, 1e-9))

    def places(self, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Subsequence numbers of a shape at all places, and which are inside."""
        n = len(self.room)
        row = np.concatenate([self.row, np.full(8, _EDGE, dtype=np.uint32)])
        number = row[:n]
        for offset in offsets:
            number = number << np.uint32(5) | row[offset:offset + n]
        return number, self.room >= offsets[-1]

    def values(self, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Sum of table values of each unit, over its length norm."""
        if not self.count:
            return np.zeros(0)
        total = np.zeros(len(self.room), dtype=np.float32)
        for offsets, weight in SHAPES:
            number, inside = self.places(offsets)
            total += tables[len(offsets) + 1][number] * (inside * np.float32(weight))
        return np.add.reduceat(total, self.edges[:-1]) / self.norms()


def image(unit: str) -> list[tuple[int, int, float]]:
    """(letters, subsequence, weight) of a unit, over its length norm."""
    own = Units([unit])
    norm, out = own.norms()[0], []
    for offsets, weight in SHAPES:
        number, inside = own.places(offsets)
        out += [(len(offsets) + 1, int(n), weight / norm) for n in number[inside]]
    return out


def empty_tables() -> dict[int, np.ndarray]:
    return {k: np.zeros(n, dtype=np.float32) for k, n in _SIZES.items()}


class Machine:
    """The SVM as subsequence tables, with the model of documents on top."""

    def __init__(self, positive: list[str], negative: list[str], landmarks: int):
        half = landmarks // 2
        chosen = list(dict.fromkeys(positive))[:half]
        chosen += list(dict.fromkeys(negative))[:landmarks - len(chosen)]
        images = [image(u) for u in chosen]
        units = Units([" ".join(positive), " ".join(negative)])
        own = Units(chosen)
        kernel, grams, tables = np.zeros((units.count, len(chosen))), np.zeros((len(chosen),) * 2), empty_tables()
        for j, parts in enumerate(images):
            for k, n, w in parts:
                tables[k][n] += w
            kernel[:, j], grams[:, j] = units.values(tables), own.values(tables)
            for k, n, _ in parts:
                tables[k][n] = 0
        values, vectors = np.linalg.eigh((grams + grams.T) / 2)
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        goal = np.where(units.owner == 0, 1.0, -1.0)
        weights, self.shift = squared_hinge(kernel @ root, goal)
        self.tables = tables
        for beta, parts in zip(root @ weights, images):
            for k, n, w in parts:
                tables[k][n] += beta * w
        self.link = np.zeros(6)

    def unit_scores(self, units: Units) -> np.ndarray:
        return units.values(self.tables) + self.shift

    def features(self, units: Units) -> np.ndarray:
        """Per text: largest score, clearly toxic units, their share, length."""
        score = self.unit_scores(units)
        top = np.full(units.texts, -2.0)
        np.maximum.at(top, units.owner, score)
        hits = np.bincount(units.owner, score > CLEAR, units.texts)
        size = np.bincount(units.owner, minlength=units.texts)
        return np.stack([
            np.clip(top, -2, 2), np.log1p(hits), np.log((hits + 0.5) / (size + 20)),
            (hits > 0).astype(float), np.log1p(size), np.ones(units.texts),
        ], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.features(Units(texts)) @ self.link
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def squared_hinge(
    x: np.ndarray, y: np.ndarray, cost: float = 10.0
) -> tuple[np.ndarray, float]:
    """Linear SVM weights and shift by Newton steps; both classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = (y > 0).mean()
    weight = cost * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y) * 100
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + xi.T @ x[inside], xi.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new if _ > 15 else new
    return w[:-1], float(w[-1])


def logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05
) -> np.ndarray:
    """Weights of a logistic model by Newton steps with halving."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z)) + ridge * float(w @ w) / 2

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def first_guess(units: Units, toxic: np.ndarray) -> np.ndarray:
    """Evidence of each unit: mean log odds of its best four-letter parts.

    Odds compare the documents of each label that hold a part.
    """
    number, inside = units.places((1, 2, 3))
    unit = np.repeat(np.arange(units.count), np.diff(units.edges))
    doc = units.owner[unit]
    seen = np.unique(doc[inside].astype(np.int64) << 20 | number[inside])
    part, of = seen & (1 << 20) - 1, toxic[seen >> 20]
    bad = np.bincount(part[of], minlength=1 << 20)
    good = np.bincount(part[~of], minlength=1 << 20)
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    odds[bad < 3] = np.minimum(odds[bad < 3], 0)
    each = np.where(inside, odds[number], -np.inf)
    order = np.lexsort((-each, unit))
    rank = np.arange(len(each)) - units.edges[unit[order]]
    best = np.where((rank < 3) & np.isfinite(each[order]), each[order], 0)
    return np.bincount(unit[order], best, units.count) / 3


def spoiled(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with one letter inserted, as evasive spellings have it."""
    if len(unit) < 4:
        return []
    at = int(rng.integers(1, len(unit)))
    return [unit[:at] + chr(97 + int(rng.integers(26))) + unit[at:]]


def trained(
    rows: list[tuple[str, int]], share: float | None = None,
    landmarks: int = LANDMARKS, rounds: int = ROUNDS,
) -> Machine:
    """Fit the machine on documents with labels.

    ``share`` is the share of toxic rows among all labelled rows; without it
    the share among ``rows`` is taken.
    """
    toxic = np.array([label == 1 for _, label in rows])
    if toxic.all() or not toxic.any():
        raise ValueError("training needs labelled rows of both kinds")
    units = Units([text for text, _ in rows])
    bad = toxic[units.owner]
    score = first_guess(units, toxic)
    rng = np.random.default_rng(0)
    machine = None
    for turn in range(rounds):
        # The three best units of each toxic document that look toxic.
        order = np.lexsort((-score, units.owner))
        rank = np.arange(units.count) - np.searchsorted(units.owner, units.owner[order], "left")
        level = np.quantile(score[~bad], 0.995) if machine is None else 0.0
        best = order[(rank < 3) & bad[order]]
        best = best[(score[best] > level) & (units.lengths[best] > 0)]
        counts: dict[str, int] = {}
        for i in best:
            word = units.word(i)
            counts[word] = counts.get(word, 0) + 1
        positive = sorted(counts, key=lambda u: (-counts[u], u))[:1500]
        positive += [v for u in positive for v in spoiled(u, rng)]
        clean = np.flatnonzero(~bad & (units.lengths > 0))
        hard = clean[np.argsort(-score[clean])][:400]
        some = rng.choice(clean, min(3000, len(clean)), replace=False)
        negative = list(dict.fromkeys(w for i in [*hard, *some] if (w := units.word(i)) not in counts))
        if not positive or not negative:
            break
        # Landmarks come from the front: mix hard and plain negatives.
        mixed = [u for pair in itertools.zip_longest(negative[:200], negative[::-1][:200]) for u in pair if u]
        machine = Machine(positive, list(dict.fromkeys(mixed + negative)), landmarks)
        score = machine.unit_scores(units)
    if machine is None:
        machine = Machine(["toxic"], ["clean"], 2)
    own = toxic.mean()
    share = own if share is None else share
    weight = np.where(toxic, share / own, (1 - share) / (1 - own))
    machine.link = logistic(machine.features(units), toxic.astype(float), weight)
    return machine


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, bound: int = SAMPLE,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Train on labelled rows that are not held out, and score all rows.

    Returns the key and ``score``.
    """
    learn = ~held_out(key, 5, 0)
    share = labels.where(learn).agg(F.avg("toxic")).first()[0]
    machine = trained(sampled(docs, labels, "toxic", learn, bound, key, text), share)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                score = own.scores(texts[part.start:part.stop])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.array(score)], [key, "score"]
                )

    batches_of(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"{key} long, score double")
