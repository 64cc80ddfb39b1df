"""Quality score of a text by a byte-level convolutional network in numpy.

Every ``STRIDE`` bytes, learned filters of ``WIDTH`` bytes look at the bytes and
at an echo plane, which says whether the next eight bytes also stand a short
distance before. Filters are tables: one weight per place, byte value and
filter. Responses are max-pooled over half chunks, two neighbours make one of
the overlapping chunks, and the chunks' maxima and means over the whole text
are combined into one probability. Texts are never cut.

The network is trained on the driver on a bounded sample of labelled rows:
at most ``SAMPLE`` per label, those with the smallest hash of the key,
so the bound does not depend on the table's size. Scoring is a pass over all
documents without a shuffle.

Defined results: a null or empty text is scored like any other, from zero
chunks' features. Rows with a null label, or whose key has several labels, are
not learned from. Repeated rows get equal scores. Extra columns are ignored.
Without labelled rows of both kinds training fails with a clear message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from filingmill.llm.common import batches_of, slices

WIDTH, STRIDE, FILTERS = 8, 4, 24
#: Bytes of half a chunk: a chunk has twice as many and overlaps the next by half.
HALF = 128
CELL = HALF // STRIDE
ECHO_LAGS = range(2, 49)
SAMPLE = 600
EPOCHS = 24
#: A text is good from this score on.
CUT = 0.7
_PAD = 256


def planes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and echo of all texts in a row, padded, and each text's first half.

    Each text fills whole half chunks and at least one. Half a chunk of padding
    follows, more than a filter or an echo reaches; it is not pooled.
    """
    raw = [t.encode(errors="surrogatepass") for t in texts]
    halves = np.array([max(1, -(-len(r) // HALF)) + 1 for r in raw])
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.full(first[-1] * HALF + WIDTH, _PAD, dtype=np.int16)
    for at, r in zip(first * HALF, raw):
        out[at:at + len(r)] = np.frombuffer(r, dtype=np.uint8)
    echo = np.zeros(len(out), dtype=bool)
    for lag in ECHO_LAGS:
        same = (out[lag:] == out[:-lag]) & (out[lag:] != _PAD)
        for shift in (1, 2, 4):
            same[:-shift] &= same[shift:]
            same[-shift:] = False
        echo[lag:] |= same
    return out, echo.astype(np.float32), first


class Network:
    """The weights, and the passes forward and back."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (WIDTH, _PAD + 1, FILTERS)).astype(np.float32)
        self.table[:, _PAD] = 0
        self.echo = rng.normal(0, 0.1, (WIDTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.echo, self.bias, self.out, self.shift]

    def pooled(self, data: np.ndarray, echo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each half chunk and filter, and where it is."""
        count = (len(data) - WIDTH) // STRIDE
        sums = np.tile(self.bias, (count, 1))
        for k in range(WIDTH):
            sums += self.table[k][data[k:k + count * STRIDE:STRIDE]]
            sums += echo[k:k + count * STRIDE:STRIDE, None] * self.echo[k]
        cells = sums.reshape(-1, CELL, FILTERS)
        return np.maximum(cells.max(axis=1), 0), cells.argmax(axis=1)

    def features(self, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maxima and means over each text's overlapping chunks."""
        rows = []
        for a, b in zip(first[:-1], first[1:] - 1):
            own = halves[a:b]
            chunks = np.maximum(own[:-1], own[1:]) if b - a > 1 else own
            rows.append(np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]))
        return np.array(rows)

    def scores(self, texts: list[str]) -> np.ndarray:
        data, echo, first = planes(texts)
        step = 4096
        halves = np.concatenate([
            self.pooled(data[i * HALF:(i + step) * HALF + WIDTH], echo[i * HALF:(i + step) * HALF + WIDTH])[0]
            for i in range(0, first[-1], step)
        ])
        # Summed row by row: a matrix product may round by its number of rows.
        z = (self.features(halves, first) * self.out).sum(axis=1) + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))

    def gradients(self, batch: tuple, goal: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss over a batch of texts."""
        data, echo, first = batch
        halves, where = self.pooled(data, echo)
        seen = self.features(halves, first)
        p = 1 / (1 + np.exp(-np.clip(seen @ self.out + self.shift, -30, 30)))
        dz = ((p - goal) * weight / len(goal)).astype(np.float32)
        dseen = dz[:, None] * self.out
        dh = np.zeros_like(halves)
        column = np.arange(FILTERS)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:] - 1)):
            own = halves[a:b]
            top = own.argmax(axis=0)
            dh[a + top, column] += dseen[i, :FILTERS]
            if b - a == 1:
                dh[a] += dseen[i, FILTERS:]
                continue
            right = own[1:] > own[:-1]
            share = dseen[i, FILTERS:] / (b - a - 1)
            dh[a + 1:b] += right * share
            dh[a:b - 1] += ~right * share
        dh *= halves > 0
        at = (np.arange(len(halves))[:, None] * CELL + where) * STRIDE
        dtable, decho = np.zeros_like(self.table), np.zeros_like(self.echo)
        for k in range(WIDTH):
            bytes_at, echo_at = data[at + k], echo[at + k]
            decho[k] = (echo_at * dh).sum(axis=0)
            for f in range(FILTERS):
                dtable[k, :, f] = np.bincount(bytes_at[:, f], dh[:, f], minlength=_PAD + 1)
        dtable[:, _PAD] = 0
        return [dtable, decho, dh.sum(axis=0), seen.T @ dz, dz.sum(keepdims=True)]


def trained(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network fitted by Adam, both labels with equal weight in all."""
    labels = np.array([label for _, label in rows])
    if len(set(labels.tolist())) < 2:
        raise ValueError("training needs labelled rows of both kinds")
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    net, rng = Network(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 16)):
            batch = planes([rows[i][0] for i in part])
            grads = net.gradients(batch, labels[part], weight[part])
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for w, g, (m, v) in zip(net.weights(), grads, moments):
                g = g + 1e-5 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
    return net


def sampled(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int,
    key: str = "doc_id", text: str = "text",
) -> list[tuple[str, int]]:
    """At most ``bound`` learnable (text, label) rows of each label.

    Keys are chosen from the labels alone, by the smallest hashes; then one
    pass over the documents fetches their texts. Of several texts of a key the
    smallest is taken.
    """
    own = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("_key")).agg(
        F.min(label).alias("low"), F.max(label).alias("high")
    ).where("low = high").withColumn("order", F.xxhash64("_key"))
    chosen = [
        (r["_key"], int(r["low"]))
        for value in (0, 1)
        for r in own.where(F.col("low") == value).orderBy("order", "_key").limit(bound).collect()
    ]
    if not chosen:
        return []
    # At most 2 x bound keys: a broadcast of known size.
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_key long, _label int"))
    texts = docs.join(few, F.col(key).cast("long") == F.col("_key")).groupBy("_key", "_label").agg(
        F.min(F.coalesce(F.col(text), F.lit(""))).alias("body")
    )
    return [(r["body"], r["_label"]) for r in texts.orderBy("_key").collect()]


def scored(
    docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for part in slices(texts):
                score = own.scores(texts[part.start:part.stop])
                rows = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(score)], [*rows.schema.names, "_score"]
                )

    batches_of(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text falls into the part kept for tests."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(parts)) == part


def quality_scores(
    docs: DataFrame, labels: DataFrame, bound: int = SAMPLE,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Train on labelled rows that are not held out, and score all rows.

    Adds ``_score`` to the columns of ``docs``.
    """
    net = trained(sampled(docs, labels, "quality", ~held_out(key, 4, 2), bound, key, text))
    return scored(docs, net, key, text)
