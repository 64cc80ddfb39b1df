"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (runs of letters and digits, lowered). A document
leaks an item if a span of it is within ``max_edits`` word edits per item word.
Items are cut into pieces of at most ``PIECE_EDITS`` allowed edits: of the
pieces of a leaked item, one at least is within its own share of the edits. So
walks stay short, however long the item. Windows as long as a piece slide over
the whole document, word by word. A window that leaks
must hold enough words, pairs and triples of the items (an edit spoils three
triples at most), so other windows are passed over without loss. The rest are embedded by CGK random walks, which turn few edits
into few differing places; each repetition samples places of one walk and looks
the result up among the pieces' samples. Matches are confirmed by the exact edit
distance between the whole item and the text around the window.

Repetitions of a piece follow from its words, its allowed edits and the recall
that is asked for. Items are taken in blocks of ``BLOCK_ITEMS`` (fewer, if they
are long): each block is one pass over the documents, and only a block is ever
sent to the tasks.

Defined results: a null or empty document leaks nothing, an item without words
is never leaked. Items with fewer than ``1 / max_edits`` words must occur
exactly. Equal items are each reported. Of overlapping spans for one item the
nearest is reported, then the first. Repeated documents are each reported. Null
keys are kept. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.llm.common import BATCH_CHARS, batches_of, slices
from filingmill.llm.words import LETTERS, mix, word_hashes, word_spans

MAX_EDITS = 0.2
TARGET_RECALL = 0.999
#: Places that a repetition samples.
SAMPLED = 3
#: Loss of equal places by edits; measured losses are up to 1.3 (edits evenly
#: spread, half of the words edited), and at most 1 at a fifth.
LOSS = 1.5
#: One walk may lose its place for good, so repetitions are dealt over many.
WALKS = 16
PIECE_EDITS = 4
#: Windows that are embedded at a time.
WINDOWS = 4_000
BLOCK_ITEMS = 20_000
#: Characters of an item in a full block, on average.
BLOCK_CHARS = 400
SEED = 7

_FACTOR = mix(np.arange(11, 11 + SAMPLED, dtype=np.uint64)) | np.uint64(1)
SCHEMA = "doc_id long, item_id long, start long, end long, n_words int, edits int"


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_ids(text: str) -> np.ndarray:
    """Hashes of the words of one text; zero is left free for the gap."""
    return word_hashes([lowered(text)], LETTERS)[0] | np.uint64(1)


def pieces(size: int, allowed: int) -> list[tuple[int, int, int]]:
    """First word, words and edits of each piece of an item.

    The edits of all pieces, each plus one, are more than those allowed for the
    item, so not all pieces can have more edits than their own.
    """
    count = min(size, max(1, -(-allowed // PIECE_EDITS)))
    cuts = [size * i // count for i in range(count + 1)]
    return [(a, b - a, allowed * (b - a) // size) for a, b in zip(cuts, cuts[1:])]


def agreement(size: int, edits: int) -> float:
    """Share of equal places to expect of a piece and a window with the edits."""
    return 1 / (1 + LOSS * edits / math.sqrt(size))


def repetitions(size: int, edits: int, recall: float = TARGET_RECALL) -> int:
    """Repetitions after which a window near the limit is found at ``recall``."""
    found = agreement(size, edits) ** SAMPLED
    return 1 if found == 1 else math.ceil(math.log(1 - recall) / math.log(1 - found))


def samples(windows: np.ndarray, reps: int) -> np.ndarray:
    """LSH keys of windows of one size, one column per repetition.

    ``windows`` holds one window per row. A walk stays at a word or goes on, as
    a random bit of the word and the step says; it needs about two steps a
    word, and 1.6 steps a word are walked and sampled.
    """
    rows, size = windows.shape
    rng = np.random.default_rng([SEED, size])
    steps = int(1.6 * size) + 1
    # A row per word, so that neighbours in memory take the same step. The last
    # row is the gap, which no walk leaves.
    words = np.zeros((size + 1, rows), dtype=np.uint64)
    words[:size] = windows.T
    flat = words.ravel()
    out = np.empty((rows, reps), dtype=np.uint64)
    seen = np.empty((steps, rows), dtype=np.uint64)
    for walk in range(min(WALKS, reps)):
        turn = rng.integers(1, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = np.arange(rows)
        for step in range(steps):
            seen[step] = flat[at]
            at += ((seen[step] * turn[step]) >> np.uint64(63)).astype(np.int64) * rows
        for rep in range(walk, reps, WALKS):
            total = mix(np.array([rep + 1, size << 32], dtype=np.uint64)).sum()
            for share, factor in zip(rng.random(SAMPLED), _FACTOR):
                total = total + seen[int(share * steps)] * factor
            out[:, rep] = mix(total)
    return out


def nearest_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any span of the text, and the span."""
    m = len(text)
    place = np.arange(m + 1)
    cost, origin = np.zeros(m + 1, dtype=np.int64), place.copy()
    for row, word in enumerate(item, 1):
        swap = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        best = np.concatenate([[row], np.minimum(swap, drop)])
        came = np.concatenate([[0], np.where(swap <= drop, origin[:-1], origin[1:])])
        # Insertions run on from the left: the least of best - place so far.
        lead = best - place
        low = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == low, place, 0))
        cost, origin = low + place, came[source]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def pair_ids(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the next."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def triple_ids(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the next two."""
    pairs = pair_ids(words)
    return mix(pairs[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:])


class Known:
    """Sorted hashes, with a table of their first bits that most others miss."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[self._first_bits(values)] = True

    def _first_bits(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the raveled ``values`` that are known, and their first index here."""
        values = values.ravel()
        spots = np.flatnonzero(self.table[self._first_bits(values)])
        low = np.searchsorted(self.values, values[spots])
        low[low == len(self.values)] = 0
        held = self.values[low] == values[spots]
        return spots[held], low[held]


def _counts(values: np.ndarray, known: Known) -> np.ndarray:
    """How many of the first values are known, for each number of them."""
    out = np.zeros(len(values) + 1, dtype=np.int64)
    if len(known.values):
        out[known.find(values)[0] + 1] = 1
    return np.cumsum(out)


class Items:
    """A block of items with their LSH samples."""

    def __init__(self, rows: list[tuple[int, str]], max_edits: float, recall: float):
        self.words = [(item, ids) for item, text in rows if len(ids := word_ids(text or ""))]
        self.allowed = [int(max_edits * len(w)) for _, w in self.words]
        if not self.words:
            return
        self.longest = max(len(w) for _, w in self.words)
        parts = [
            (owner, *part) for owner, (_, w) in enumerate(self.words)
            for part in pieces(len(w), self.allowed[owner])
        ]
        #: Most edits of the pieces of each size.
        self.edits: dict[int, int] = {}
        for _, _, size, edits in sorted(parts):
            self.edits[size] = max(edits, self.edits.get(size, 0))
        self.sizes = sorted(self.edits)
        self.width = self.sizes[-1]
        self.reps = {size: repetitions(size, self.edits[size], recall) for size in self.sizes}
        self.vocabulary = Known(np.unique(np.concatenate([w for _, w in self.words])))
        self.pairs = Known(np.unique(np.concatenate([pair_ids(w) for _, w in self.words])))
        self.triples = Known(np.unique(np.concatenate([triple_ids(w) for _, w in self.words])))
        keys, held = [], []
        for size in self.sizes:
            own = np.array([(owner, first) for owner, first, n, _ in parts if n == size], dtype=np.int32)
            grid = np.stack([self.words[owner][1][first:first + size] for owner, first in own])
            keys.append(samples(grid, self.reps[size]).ravel())
            held.append(np.repeat(own, self.reps[size], axis=0))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys = Known(flat[order])
        self.owners, self.firsts = np.concatenate(held)[order].T
        # A window with k edits has n - 2 - 3k word triples of the item, and of
        # its runs of triples one holds its share of them.
        self.run, self.run_least = 0, 0
        for run in range(1, self.sizes[0] - 1):
            least = run - max(3 * self.edits[n] // ((n - 2) // run) for n in self.sizes)
            if least > 0 and least * max(self.run, 1) >= self.run_least * run:
                self.run, self.run_least = run, least

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sizes, and starts of their windows with enough words, pairs and triples."""
        triples = _counts(triple_ids(words), self.triples)
        spots = np.arange(len(words))
        if self.run:
            dense = np.flatnonzero(triples[self.run:] - triples[:-self.run] >= self.run_least)
            # Places from which some window may reach a dense run.
            mark = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(mark, np.maximum(dense - self.width + self.run, 0), 1)
            np.add.at(mark, dense + 1, -1)
            spots = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        sums, pairs = _counts(words, self.vocabulary), _counts(pair_ids(words), self.pairs)
        for size in self.sizes:
            edits = self.edits[size]
            own = spots[spots + size <= len(words)]
            held = (sums[own + size] - sums[own] >= size - edits) & (
                pairs[own + size - 1] - pairs[own] >= size - 1 - 2 * edits
            )
            own = own[held]
            if size > 1:
                own = own[triples[own + size - 2] - triples[own] >= size - 2 - 3 * edits]
            yield size, own

    def candidates(self, words: np.ndarray) -> dict[int, list[int]]:
        """Starts by item, from windows that share a sample with one of its pieces."""
        found: dict[int, set[int]] = defaultdict(set)
        known = self.keys.values
        for size, starts in self.windows(words):
            reps = self.reps[size]
            for first in range(0, len(starts), WINDOWS):
                begin = starts[first:first + WINDOWS]
                keys = samples(words[begin[:, None] + np.arange(size)], reps)
                spots, low = self.keys.find(keys)
                high = np.searchsorted(known, known[low], "right")
                for row, start, end in zip(begin[spots // reps], low, high):
                    for owner, first_word in zip(self.owners[start:end], self.firsts[start:end]):
                        found[int(owner)].add(int(row) - int(first_word))
        return {owner: sorted(places) for owner, places in found.items()}

    def leaks(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, first word, end word, item words, edits) of confirmed spans."""
        for owner, places in self.candidates(words).items():
            item, own = self.words[owner]
            # Edits before or after the piece move the span, edits in it the window.
            slack, spans = self.allowed[owner] + PIECE_EDITS + 1, []
            # Windows next to each other are confirmed as one stretch.
            stretches = []
            for place in places:
                low, high = place - slack, place + len(own) + slack
                if stretches and low <= stretches[-1][1] - len(own):
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            # What is left and right of a span may hold another.
            rest = [(max(low, 0), high) for low, high in stretches]
            while rest:
                low, high = rest.pop()
                near, least = words[low:high], len(own) - self.allowed[owner]
                # An edit spoils one word and two pairs of the item at most.
                if len(near) < least or np.isin(near, own).sum() < least:
                    continue
                if np.isin(pair_ids(near), pair_ids(own)).sum() < 2 * least - len(own) - 1:
                    continue
                edits, start, end = nearest_span(own, near)
                if edits <= self.allowed[owner] and end > start:
                    spans.append((edits, low + start, low + end))
                    rest += [(low, low + start), (low + end, high)]
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(spans):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    yield item, start, end, len(own), edits


def _pass(docs: DataFrame, block: Items) -> DataFrame:
    """One pass over all documents with one block of items."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)
    names = ["doc_id", "item_id", "start", "end", "n_words", "edits"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts, BATCH_CHARS):
                own = [lowered(t) for t in texts[part.start:part.stop]]
                words, first, starts, ends = word_spans(own, LETTERS)
                # One long row of words with gaps, so a part needs few steps.
                counts = np.diff(first)
                begin = first[:-1] + items.longest * np.arange(len(part))
                row = np.zeros(len(words) + items.longest * (len(part) + 1), dtype=np.uint64)
                row[np.arange(len(words)) + np.repeat(begin - first[:-1], counts)] = words | np.uint64(1)
                at, out = None, []
                for item, start, end, size, edits in items.leaks(row):
                    doc = int(np.searchsorted(begin, end - 1, "right")) - 1
                    shift = int(first[doc] - begin[doc])
                    start = max(start + shift, int(first[doc]))
                    end = min(end + shift, int(first[doc + 1]))
                    if start >= end:
                        continue
                    if at is None:
                        at = np.cumsum([0, *(len(t.encode(errors="surrogatepass")) + 1 for t in own)])
                    chars = chars_of(own[doc], starts[start] - at[doc], ends[end - 1] - at[doc])
                    out.append((ids[part.start + doc], item, *chars, size, edits))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names
                    )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, SCHEMA)


def chars_of(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of a span of bytes."""
    raw = text.encode(errors="surrogatepass")
    return tuple(len(raw[:at].decode(errors="surrogatepass")) for at in (start, end))


def leaks(
    docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS,
    recall: float = TARGET_RECALL, block_items: int = BLOCK_ITEMS,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Spans of documents that leak an item.

    Returns doc_id, item_id, start and end in code points, the item's words and
    the word edits.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    batches_of(docs.sparkSession)
    own = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).cast("string").alias("body"))
    count, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.char_length("body")), F.lit(0))).first()
    blocks = max(count // block_items, chars // (block_items * BLOCK_CHARS)) + 1
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)))
    passes = []
    for number in range(blocks):
        held = [(r.id, r.body) for r in own.where(F.col("block") == number).orderBy("id", "body").collect()]
        block = Items(held, max_edits, recall)
        if block.words:
            passes.append(_pass(rows, block))
    if not passes:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return functools.reduce(DataFrame.unionByName, passes)
