"""Spelling variants by k-d trees over letter counts.

A word is a point: how often it has each letter. One edit moves a point by at
most two in L1 distance: a replaced letter takes one from a count and adds one
to another, an inserted letter adds one. So the near words of a word lie, for
its own length, in the ball of radius two around it and, for the next length,
in the ball of radius one. Each length has its own tree; each pair of lengths
is a range search in the longer one's tree, which skips a box as soon as it is
further away. Pairs that remain are verified letter by letter.

The upper levels of the trees are grown from a sample of the words, of at most
``SAMPLE`` words; they deal all words to leaves and every word, as a question,
to the leaves that its ball meets. A leaf is stored in blocks of at most about
``BLOCK_WORDS`` words, however many words share one point, and grows the lower
levels over all words of a block. Only counts and the best near word of each
word leave a block, never pairs.

Defined results: a null text has no words; a null key counts as the empty text
in the hash that chooses runs to shorten. Repeated rows count each time. Words
may be as long as a task's memory allows. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.llm.common import batches_of, stored, text_of

#: Words that the upper levels are grown from.
SAMPLE = 1 << 17
#: Words of a block, letters of a block, and points of a lower leaf.
BLOCK_WORDS, BLOCK_LETTERS, LEAF_POINTS = 1 << 14, 1 << 22, 48
#: Words that a task deals to leaves at once, and their letters.
DEAL_WORDS, DEAL_LETTERS = 1 << 16, 1 << 21

# A-Z as a-z; other bytes that cannot belong to a run as blanks.
_RUNS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
#: Leads of the letters beyond U+00FF and of U+0080 to U+00BF.
_FAR = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")


def runs_of(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    if _FAR.search(text):
        text = _FAR.sub(b" ", text)
    return text.translate(_RUNS).split()


def shortened(key: str, run: bytes, every: int) -> bytes:
    """The run without one letter, if the hash of key and run says so."""
    code = zlib.crc32(run, zlib.crc32(f"{key}:".encode()))
    if code % every:
        return run
    letters = run.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(
    docs: DataFrame, least_letters: int = 6, every: int = 199, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n) over all texts. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        total: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )
            total.clear()
            return out

        for batch in batches:
            for own, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = "" if own is None else str(own)
                prefix = crc(f"{name}:".encode())
                for word, n in Counter(runs_of(cell.as_py())).items():
                    # Bytes are at least letters; the exact test is below.
                    if len(word) < least_letters:
                        continue
                    if not crc(word, prefix) % every:
                        word = shortened(name, word, every)
                    if len(word) >= least_letters and (
                        word.isascii() or len(word) - word.count(b"\xc3") >= least_letters
                    ):
                        total[word] += n
                if len(total) > 500_000:
                    yield counted()
        if total:
            yield counted()

    batches_of(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string"), text_of(text).cast("binary"))
    counts = rows.mapInArrow(run, "word binary, n long")
    return counts.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters (0 behind a word's end), and counts of the letters.

    Letters are a-z and U+00C0 to U+00FF, and all others as one, so that an
    edit still moves a point by two at most.
    """
    longest = max(map(len, words), default=0)
    raw = np.array(words, dtype=f"<U{max(longest, 1)}").view(np.uint32).reshape(len(words), -1)
    which = np.full(raw.shape, 90, dtype=np.int64)
    small, high = (raw >= 97) & (raw <= 122), (raw >= 0xC0) & (raw <= 0xFF)
    which[small] = raw[small] - 97
    which[high] = raw[high] - 0xC0 + 26
    which[raw == 0] = 91
    at = which + np.arange(len(words))[:, None] * 92
    counts = np.bincount(at.ravel(), minlength=len(words) * 92).reshape(len(words), 92)[:, :91]
    return raw, counts.astype(np.int16 if longest < 1 << 15 else np.int32)


class Tree:
    """A k-d tree over points; a leaf is a number and a list of rows."""

    def __init__(self, counts: np.ndarray, leaf_points: int):
        self.letter: list[int] = []
        self.value: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        self._grow(counts, np.arange(len(counts)), leaf_points)

    def _grow(self, counts: np.ndarray, rows: np.ndarray, leaf_points: int) -> int:
        """Add a node; a leaf is the negative of its number less one."""
        if len(rows) > leaf_points:
            own = counts[rows]
            spread = own.var(axis=0)
            letter = int(spread.argmax())
            if spread[letter] > 0:
                value = int(np.median(own[:, letter]))
                if value == own[:, letter].max():
                    value -= 1
                node = len(self.letter)
                self.letter.append(letter)
                self.value.append(value)
                self.child.append((0, 0))
                low = own[:, letter] <= value
                self.child[node] = (
                    self._grow(counts, rows[low], leaf_points), self._grow(counts, rows[~low], leaf_points)
                )
                return node
        self.leaves.append(rows)
        return -len(self.leaves)

    def search(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, questions) for the leaves within reach of each question.

        A reachable point has at most ``up`` more of some letters and at most
        ``down`` fewer of others. All questions walk down together.
        """
        root = 0 if self.letter else -1
        full = np.zeros(len(counts), dtype=np.int16)
        # Per letter the steps already taken, as a box may be left twice at it.
        walk = [(root, np.arange(len(counts)), full + up, full + down, {})]
        while walk:
            node, rows, ups, downs, taken = walk.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            letter, value = self.letter[node], self.value[node]
            own = counts[rows, letter]
            used = taken.get(letter)
            used = np.zeros(len(rows), dtype=np.int16) if used is None else used
            # Distance of the point to each side along this letter.
            for side, gap in ((0, np.minimum(value - own, 0)), (1, np.maximum(value + 1 - own, 0))):
                now = np.where(np.abs(gap) > np.abs(used), gap, used).astype(np.int16)
                left_up = ups - (np.maximum(now, 0) - np.maximum(used, 0))
                left_down = downs - (np.maximum(-now, 0) - np.maximum(-used, 0))
                go = (left_up >= 0) & (left_down >= 0)
                walk.append((
                    self.child[node][side], rows[go], left_up[go], left_down[go],
                    {**{k: v[go] for k, v in taken.items()}, letter: now[go]},
                ))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of letter codes that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows where ``long`` is ``short`` with one letter more."""
    size = short.shape[1]
    front = np.logical_and.accumulate(short == long[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


class Leaf:
    """All words of a block, of one length, under a tree of their own."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, counts = points(words)
        self.used = np.flatnonzero(counts.any(axis=0))
        self.counts = counts[:, self.used]
        self.tree = Tree(self.counts, LEAF_POINTS)

    def near(self, asking: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (question, row) that are near; ``longer`` says by a letter."""
        codes, counts = points(asking)
        reach = 1 if longer else 2
        # Letters that no word here has can only be lost, and only one of them.
        lost = counts.sum(axis=1) - counts[:, self.used].sum(axis=1)
        able = np.flatnonzero(lost <= (0 if longer else 1))
        own = counts[able][:, self.used]
        rows: list[np.ndarray] = []
        for leaf, few in self.tree.search(own, 1, 0 if longer else 1):
            there = self.tree.leaves[leaf]
            gaps = np.abs(own[few][:, None, :] - self.counts[there][None, :, :]).sum(axis=2)
            q, r = np.nonzero(gaps + lost[able[few]][:, None] <= reach)
            rows.append(np.stack([able[few[q]], there[r]]))
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        q, r = np.concatenate(rows, axis=1)
        good = []
        for start in range(0, len(q), 1 << 16):
            a, b = codes[q[start:start + (1 << 16)]], self.codes[r[start:start + (1 << 16)]]
            good.append(one_inserted(a, b) if longer else one_replaced(a, b))
        good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
        return q[good], r[good]


def grown_trees(words: DataFrame, sample: int) -> dict[int, Tree]:
    """A tree per length over at most ``sample`` words; leaves grow with all."""
    total = words.count()
    share = min(1.0, sample / max(total, 1))
    # The same words whatever their order: those of the smallest hashes.
    limit = int(share * (1 << 32)) - (1 << 31)
    chosen = words.where(F.hash("word") <= F.lit(limit)) if share < 1 else words
    held: dict[int, list[str]] = {}
    for row in chosen.select("word").limit(2 * sample).toLocalIterator():
        held.setdefault(len(row.word), []).append(row.word)
    trees = {}
    for length, own in held.items():
        block = max(1, min(BLOCK_WORDS, BLOCK_LETTERS // length))
        trees[length] = Tree(points(own)[1], max(16, int(block * share)))
        trees[length].leaves = [np.zeros(0)] * len(trees[length].leaves)
    return trees


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """Words and their n, many at a time."""
    words, ns, letters = [], [], 0
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.append(word)
            ns.append(n)
            letters += len(word)
            if len(words) >= DEAL_WORDS or letters >= DEAL_LETTERS:
                yield words, ns
                words, ns, letters = [], [], 0
    if words:
        yield words, ns


def _dealt(words: DataFrame, trees: dict[int, Tree], asking: bool) -> DataFrame:
    """Words packed by leaf: their own, or all that a question must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ns in _held(batches):
            sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                own = [held[i] for i in at]
                count = np.array([ns[i] for i in at])
                _, counts = points(own)
                for longer in (False, True) if asking else (False,):
                    tree = trees.get(length + longer)
                    if tree is None:
                        if asking:
                            continue
                        yield packed(length, 0, False, own, count)
                        continue
                    reach = (1, 0 if longer else 1) if asking else (0, 0)
                    for leaf, few in tree.search(counts, *reach):
                        yield packed(length + longer, leaf, longer, [own[i] for i in few], count[few])

    def packed(length: int, leaf: int, longer: bool, own: list[str], count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([length], pa.int32()), pa.array([leaf], pa.int32()), pa.array([longer]),
             pa.array([own], pa.list_(pa.string())), pa.array([count], pa.list_(pa.int64()))],
            ["length", "leaf", "longer", "words", "ns"],
        )

    return words.select("word", "n").mapInArrow(
        run, "length int, leaf int, longer boolean, words array<string>, ns array<long>"
    )


def near_words(words: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, best) for words that have near words.

    ``best`` is the struct (n, word) of the most frequent near word; ties go
    to the first in code-point order.
    """
    trees = grown_trees(words, sample)
    # A length that the sample lacks is a tree of one leaf.
    for row in words.select(F.char_length("word").alias("size")).distinct().toLocalIterator():
        trees.setdefault(row["size"], Tree(np.zeros((1, 91), dtype=np.int16), 1))
    own = stored(_dealt(words, trees, asking=False), "own-leaves")
    one = own.select("length", "leaf", F.explode(F.arrays_zip("words", "ns")).alias("w")).select(
        "length", "leaf", F.col("w.words").alias("word"), F.col("w.ns").alias("n")
    )
    full = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.lit(BLOCK_LETTERS) / F.col("length")))
    sizes = own.groupBy("length", "leaf").agg(F.sum(F.size("words")).alias("size")).select(
        "length", "leaf", F.ceil(F.col("size") / full).cast("int").alias("parts")
    )
    block = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    blocks = one.join(sizes, ["length", "leaf"]).withColumn("block", block).groupBy("length", "leaf", "block").agg(
        F.collect_list(F.struct("word", "n")).alias("held")
    )
    asked = _dealt(words, trees, asking=True).join(sizes, ["length", "leaf"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    cells = asked.join(blocks, ["length", "leaf", "block"]).select(
        F.struct("length", "leaf", "block").alias("cell"), "longer", "words", "ns", "held"
    )
    names = ["word", "n_near", "best_n", "best_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, leaf, held, counts = None, None, [], np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                cell = tuple(batch.column(0)[i].as_py().values())
                if cell != known:
                    rows = batch.column(4)[i].values
                    held = rows.field(0).to_pylist()
                    counts = rows.field(1).to_numpy()
                    known, leaf = cell, Leaf(held)
                longer = batch.column(1)[i].as_py()
                asking = batch.column(2)[i].as_py()
                ns = batch.column(3)[i].values.to_numpy()
                q, r = leaf.near(asking, longer)
                out = best_of(q, asking, counts[r], np.array(held, dtype=object)[r])
                if longer:
                    back = best_of(r, held, ns[q], np.array(asking, dtype=object)[q])
                    out = [a + b for a, b in zip(out, back)]
                if out[0]:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    found = cells.mapInArrow(run, "word string, n_near long, best_n long, best_word string")
    # The smallest (-n, word) is the most frequent, then the first word.
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best_word")).alias("top")
    ).select("word", "n_near", F.struct((-F.col("top.n")).alias("n"), F.col("top.best_word").alias("word")).alias("best"))


def best_of(which: np.ndarray, words: list[str], ns: np.ndarray, others: np.ndarray) -> list[list]:
    """Per word: how many others it has, and the most frequent of them."""
    order = sorted(range(len(which)), key=lambda i: (which[i], -ns[i], others[i]))
    out: list[list] = [[], [], [], []]
    for i in order:
        word = words[which[i]]
        if out[0] and out[0][-1] == word:
            out[1][-1] += 1
        else:
            for column, value in zip(out, (word, 1, int(ns[i]), others[i])):
                column.append(value)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling the steps.

    A form is more frequent than its word, so chains end; each round follows
    twice as many steps as the one before.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = stored(
            links.join(step, "root", "left").select(
                "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")
            ),
            "roots",
        )
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            return links


def spelling_groups(
    docs: DataFrame, least_letters: int = 6, least_n: int = 5, ratio: int = 5, every: int = 199,
    sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word.

    Words have at least ``least_letters`` letters and occur at least
    ``least_n`` times; a form is at least ``ratio`` times as frequent.
    """
    words = stored(word_counts(docs, least_letters, every, key, text).where(F.col("n") >= least_n), "words")
    near = near_words(words, sample)
    good = F.col("best.n") >= ratio * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(good, F.col("best.word")).alias("form"), F.when(good, F.col("best.n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
