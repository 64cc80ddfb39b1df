"""Hard negatives by vertical scans with bounds (BOND).

Vectors are quantised to integers and kept in blocks by dimension: one column
per dimension, with the column's smallest and largest value. For an anchor the
dimensions of a block are read in descending order of the anchor's magnitude.
After each few dimensions the partial scores, plus the least and the most that
the dimensions not read yet can add, bound every row's score; rows that can no
longer matter leave the candidate bitmap. What stays to the end has its exact
score.

A first scan finds the anchor's positives: rows of its label among the best.
A second one, which knows their scores, looks for rows of other labels inside
the positives' score windows. Blocks of rows and groups of anchors meet as
cells of a grid, so neither side is gathered, and each cell gives back at most
a few rows per anchor.

Defined results: a row without key, label or vector, or with a component that
is null, not finite or so large that scores would not fit 64 bits, takes no
part. A vector that is shorter than another counts as ended by zeros. Rows that
repeat key, label and vector count once; rows that share a key alone are
different rows, but never each other's positives or negatives. Ties go to the
smaller key. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingmill.llm.common import stored

#: Rows of a block, anchors of a group, and values that each may hold.
BLOCK_ROWS, GROUP_ANCHORS, BLOCK_VALUES = 8192, 4096, 1 << 20
#: Tasks that the cells are dealt to at most.
CELL_TASKS = 2000
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: Whole numbers up to here are exact as floats.
EXACT = float(1 << 53)


def quantised(vector: str, scale: int) -> Column:
    """Components as floor(scale * x), null if one of them is unfit."""
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # The sum of products of a vector's length stays below 2^62.
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector), F.lit(1)))
    fit = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale < most),
    )
    return F.when(fit, parts.cast("array<bigint>"))


def packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all, after that number."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, dtype=f"i{held[0]}", offset=1).astype(np.int64)


def packed_vectors(rows: DataFrame) -> DataFrame:
    """The rows with ``vector`` packed."""
    names = rows.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edges = batch.column(at).flatten().to_numpy(), batch.column(at).offsets.to_numpy()
            edges = edges - edges[0]
            vectors = pa.array([packed(flat[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], vectors, *batch.columns[at + 1:]], names)

    return rows.mapInArrow(run, ", ".join(
        f"{c} {'binary' if c == 'vector' else kind}" for c, kind in rows.dtypes
    ))


def packed_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of (id, label, vector): ids, labels, and values by dimension."""
    names = ["rows", "dims", "ids", "labels", "cells"]

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors = zip(*held)
        dims = max(map(len, vectors))
        cells = np.zeros((dims, len(ids)), dtype=np.int64)
        for i, v in enumerate(vectors):
            cells[:len(v), i] = v
        return pa.RecordBatch.from_arrays([
            pa.array([len(ids)]), pa.array([dims]),
            *(pa.array([packed(np.asarray(x, dtype=np.int64))], pa.binary()) for x in (ids, labels, cells)),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, widest = [], 1
        for batch in batches:
            vectors = batch.column(2)
            flat, edges = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()
            edges = edges - edges[0]
            for i, (key, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                vector = flat[edges[i]:edges[i + 1]]
                widest = max(widest, len(vector))
                if len(held) == BLOCK_ROWS or (held and (len(held) + 1) * widest > BLOCK_VALUES):
                    yield block(held)
                    held, widest = [], max(1, len(vector))
                held.append((key, label, vector))
        if held:
            yield block(held)

    return rows.select("id", "label", "vector").mapInArrow(
        run, "rows long, dims long, ids binary, labels binary, cells binary"
    )


class Block:
    """Rows of a block by dimension, and what its dimensions can add.

    Ids, labels and cells are buffers of 64-bit integers.
    """

    def __init__(self, ids, labels, cells, dims: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.labels = np.frombuffer(labels, dtype=np.int64)
        self.cells = np.frombuffer(cells, dtype=np.int64).reshape(dims, len(self.ids))
        self.low, self.high = self.cells.min(axis=1), self.cells.max(axis=1)
        self.most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))
        # Products of floats are faster; sums below 2^53 are exact in them.
        self.floats = self.cells.astype(float) if self.most.max(initial=0) < EXACT else None
        self.unique = len(np.unique(self.ids)) == len(self.ids)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep`` lets pass at every step, with their scores.

        ``keep(rows, least, most)`` says which rows may matter, given bounds of
        their scores, which are as far apart for each row.
        """
        dims = min(len(anchor), len(self.cells))
        order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
        order = order[anchor[order] != 0]
        weight = anchor[order]
        ends = np.stack([weight * self.low[order], weight * self.high[order]])
        # What the dimensions from each place on add at least and at most.
        least, most = (
            np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0))
        )
        cells = self.cells
        if self.floats is not None and np.abs(weight.astype(float)) @ self.most[order] < EXACT:
            cells, weight = self.floats, weight.astype(float)
        score = np.zeros(len(rows), dtype=cells.dtype)
        for at in range(0, len(order), STEP):
            if not len(rows):
                break
            few = order[at:at + STEP]
            if 4 * len(rows) > len(self.ids):
                part = weight[at:at + STEP] @ cells[few]
                score += part if len(rows) == len(self.ids) else part[rows]
            else:
                score += weight[at:at + STEP] @ cells[few[:, None], rows]
            done = min(at + STEP, len(order))
            alive = keep(rows, score + least[done], score + most[done])
            if not alive.all():
                rows, score = rows[alive], score[alive]
        if not len(order):
            alive = keep(rows, score, score)
            rows, score = rows[alive], score[alive]
        return rows, score.astype(np.int64)


def best_rule(count: int):
    """Keeps what may be among the ``count`` best."""

    def keep(rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(rows) <= count:
            return np.ones(len(rows), dtype=bool)
        return most >= np.partition(least, len(least) - count)[len(least) - count]

    return keep


def window_rule(low: np.ndarray, high: np.ndarray, count: int):
    """Keeps what may be among the ``count`` best inside one of the windows."""
    # Windows that overlap are one for rows that may lie in any of them.
    joined: list[list] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    widest = max(b - a for a, b in zip(low.tolist(), high.tolist()))

    def keep(rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(rows), dtype=bool)
        if len(rows) and most[0] - least[0] > widest:
            # No row is sure to lie in a window yet.
            for a, b in joined:
                alive |= (most >= a) & (least <= b)
            return alive
        for a, b in zip(low, high):
            need = a
            sure = least[(least >= a) & (most <= b)]
            if len(sure) >= count:
                need = np.partition(sure, len(sure) - count)[len(sure) - count]
            alive |= (most >= need) & (least <= b)
        return alive

    return keep


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the best ``count``, by score and then key, repeats left out."""
    order = np.lexsort((ids, -scores))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(scores[order]) != 0)
    return order[fresh][:count]


def _cells(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of rows with each group of anchors.

    Both sides are dealt to the cells of a grid: blocks by slots, anchors by
    groups. A cell holds a few blocks and one group.
    """
    slots = max(1, blocks.count())
    held = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("vector")).alias("bytes")).first()
    groups = max(-(-held["n"] // GROUP_ANCHORS), -(-(held["bytes"] or 0) // BLOCK_VALUES), 1)
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grouped = anchors.withColumn("grp", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).groupBy("grp").agg(
        F.collect_list(F.struct(*anchors.columns)).alias("anchors")
    ).withColumn("slot", deal(slots))
    placed = blocks.withColumn(
        "slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    ).withColumn("grp", deal(groups))
    # The planner takes the files' size for that of the copies, and for the work.
    tasks = min(slots * groups, CELL_TASKS)
    placed, grouped = (x.repartition(tasks, "slot", "grp") for x in (placed, grouped))
    return placed.join(grouped.hint("merge"), ["slot", "grp"]).select("dims", "ids", "labels", "cells", "anchors")


def _scanned(cells: DataFrame, search, schema: str) -> DataFrame:
    """Run ``search(block, anchor)`` for each anchor of each cell.

    It yields rows of the schema's columns.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, ids, labels, values, anchors = (batch.column(c)[i].as_py() for c in range(5))
                block = Block(unpacked(ids), unpacked(labels), unpacked(values), dims)
                out = [row for anchor in anchors for row in search(block, anchor)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return cells.mapInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, anchor_step: int = 50, positives: int = 5, negatives: int = 3,
    low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """The first negatives of each anchor and positive, best first.

    Anchors are the rows whose key ``anchor_step`` divides. A negative's score
    is at least ``low`` (a fraction) and at most ``high`` of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score.
    """
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        quantised(vector, scale).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    blocks = stored(packed_blocks(named), "vector-blocks")
    chosen = named.where(F.col("id") % anchor_step == 0).dropDuplicates(["id", "label", "vector"])
    named_anchors = chosen.select(
        F.xxhash64("id", "label", "vector").alias("anchor"), F.col("id").alias("own"), "label", "vector"
    )
    anchors = stored(packed_vectors(named_anchors), "anchors")

    def alike(block: Block, anchor: dict) -> Iterator[tuple]:
        mine = np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["own"]))
        # Rows that repeat another one take no place from it.
        found, scores = block.scan(unpacked(anchor["vector"]), mine, best_rule(positives + repeats(block, mine)))
        for i in _first(block.ids[found], scores, positives):
            yield anchor["anchor"], anchor["own"], int(block.ids[found[i]]), int(scores[i])

    def unlike(block: Block, anchor: dict) -> Iterator[tuple]:
        scores = np.asarray(anchor["scores"], dtype=object)
        least = np.array([-(-low[0] * s // low[1]) for s in scores], dtype=np.int64)
        most = np.array([high[0] * s // high[1] for s in scores], dtype=np.int64)
        fit = least <= most
        if not fit.any():
            return
        others = np.flatnonzero((block.labels != anchor["label"]) & (block.ids != anchor["own"]))
        count = negatives + repeats(block, others)
        found, own = block.scan(unpacked(anchor["vector"]), others, window_rule(least[fit], most[fit], count))
        ids = block.ids[found]
        for place in np.flatnonzero(fit):
            inside = np.flatnonzero((own >= least[place]) & (own <= most[place]))
            for i in _first(ids[inside], own[inside], negatives):
                at = inside[i]
                yield anchor["anchor"], int(place), int(ids[at]), int(own[at])

    near = _scanned(_cells(blocks, anchors), alike, "anchor long, own long, id long, score long").distinct()
    order = [F.col("score").desc(), F.col("id").asc()]
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor", "own").orderBy(*order)) - 1)
    best = stored(ranked.where(F.col("place") < positives), "positives")
    known = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("found"))
    asking = stored(
        anchors.join(known, "anchor").select("anchor", "own", "label", "vector", F.col("found.score").alias("scores")),
        "asking",
    )
    tried = _scanned(_cells(blocks, asking), unlike, "anchor long, place long, id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    taken = tried.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return best.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(
        taken.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["anchor", "place"]
    ).select(
        F.col("own").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def repeats(block: Block, rows: np.ndarray) -> int:
    """How many of the rows repeat the key of another one."""
    return 0 if block.unique else len(rows) - len(np.unique(block.ids[rows]))
