"""Points of units and queries, worked out on arrays of numbers.

A posting of a common word counts in some twenty queries, and each of them
becomes a row of the result. Hashing rows with the chunk's text keys several
times is most of the work then. Here a task reads the postings of whole chunks,
in the order of chunks, as arrays; text keys are only looked up for the result.
One chunk's postings must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def coded(*columns: np.ndarray) -> np.ndarray:
    """One number for each row, the same where rows agree in all columns."""
    code, size = np.zeros(len(columns[0]), dtype=np.int64), 1
    for column in columns:
        low = int(column.min(initial=0))
        span = int(column.max(initial=0)) - low + 1
        if size * span >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = len(code)
        code, size = code * span + (column - low), size * span
    return code


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by group, and where each group begins in it."""
    order = np.argsort(code)
    held = code[order]
    return order, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])[:len(held)])


class Lists:
    """Numbers that belong to each number below ``size``."""

    def __init__(self, pairs: Sequence[tuple[int, int]], size: int):
        pairs = sorted(pairs)
        self.items = np.array([b for _, b in pairs], dtype=np.int64)
        self.ends = np.searchsorted([a for a, _ in pairs], np.arange(size + 1))

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of a value and the item, for each item of each value."""
        first, counts = self.ends[values], self.ends[values + 1] - self.ends[values]
        rows = np.repeat(np.arange(len(values)), counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rows, self.items[first[rows] + within]


class Points:
    """Scores units by queries, from refs with their elements and queries."""

    def __init__(self, refs: Sequence, bonus: int, most: int, digit: int):
        self.bonus, self.most, self.digit = bonus, most, digit
        refs = [r for r in refs if r.elements and min(r.elements) >= 0]
        used = {(e, r.ref, r.n_words) for r in refs for e in r.elements}
        asked = {(r.section_key, r.query_index): None for r in refs}
        self.asked = [*asked]
        numbers = {k: n for n, k in enumerate(asked)}
        size = 1 + max([0, *(max(e, r) for e, r, _ in used)])
        self.refs = Lists([(e, r) for e, r, _ in used], size)
        self.queries = Lists([(r.ref, numbers[r.section_key, r.query_index]) for r in refs], size)
        self.n_words = np.zeros(size, dtype=np.int64)
        # The fewest words of a phrase that has the element.
        self.fewest = np.full(size, np.iinfo(np.int64).max)
        for e, r, n in used:
            self.n_words[r] = n
            self.fewest[e] = min(self.fewest[e], n)

    def met(self, group, element, start, times, line, mask) -> tuple[np.ndarray, ...]:
        """Group, ref, count, first line, its mask and last line of what is there."""
        # A phrase is not there where fewer words fit than it has.
        words = np.where(self.fewest[element] > 0, times, 0)
        order, edges = grouped(coded(group, start))
        total = np.empty(len(order), dtype=np.int64)
        total[order] = np.repeat(np.add.reduceat(words[order], edges), np.diff(np.append(edges, len(order))))
        kept = np.flatnonzero(total >= self.fewest[element])
        rows, ref = self.refs.of(element[kept])
        rows = kept[rows]
        if not len(rows):
            return (rows,) * 6
        order, edges = grouped(coded(group[rows], start[rows], ref))
        rows, ref = rows[order], ref[order]
        n = np.add.reduceat(times[rows], edges)
        first = np.minimum.reduceat(line[rows] * 128 + mask[rows], edges)
        last = np.maximum.reduceat(line[rows], edges)
        group, ref = group[rows[edges]], ref[edges]
        there = (self.n_words[ref] == 0) | (n == self.n_words[ref])
        return tuple(x[there] for x in (group, ref, n, first // 128, first % 128, last))

    def units(self, group, ref, n, line, mask, last) -> tuple[np.ndarray, ...]:
        """The units of each row: alone, with the next and with the last line."""
        alone, both, after = (last == line), (last == line) | (last == line + 1), np.where(mask & 64, line, line + 1)
        parts = [
            (fits, begin[fits], size, end[fits], np.where(mask[fits] & (8 * bit), self.digit, 0))
            for bit, fits, begin, size, end in (
                (1, alone & (mask & 1 > 0), line, 1, line), (2, both & (mask & 2 > 0), line, 2, after),
                (4, alone & (mask & 4 > 0), line - 1, 2, line),
            )
        ]
        join = lambda pick: np.concatenate([pick(p) for p in parts])
        return (
            join(lambda p: group[p[0]]), join(lambda p: p[1]), join(lambda p: np.full(len(p[1]), p[2])),
            join(lambda p: p[3]), join(lambda p: p[4]), join(lambda p: ref[p[0]]), join(lambda p: n[p[0]]),
        )

    def hits(self, group, element, start, times, line, mask) -> tuple[np.ndarray, ...]:
        """Group, line_start, size, line_end and digit of each unit with a hit, and its hits.

        Those are the place of each unit's first hit, and all hits: the query's
        number above the 32 bits of its points.
        """
        *unit, ref, n = self.units(*self.met(group, element, start, times, line, mask))
        place = coded(*unit)
        order, edges = grouped(coded(place, ref))
        if not len(order):
            return (*unit, np.zeros(1, dtype=np.int64), n)
        n, first = np.add.reduceat(n[order], edges), order[edges]
        points = np.where(self.n_words[ref[first]] == 0, np.minimum(n, self.most), self.bonus)
        rows, query = self.queries.of(ref[first])
        first, points = first[rows], points[rows]
        order, edges = grouped(coded(place[first], query))
        hits = (query[order[edges]] << 32) + np.add.reduceat(points[order], edges)
        first = first[order[edges]]
        at = np.flatnonzero(np.diff(place[first], prepend=-1))
        return (*(x[first[at]] for x in unit), np.append(at, len(hits)), hits)


def chunk_numbers(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """The chunk of each row, numbered from 0; chunks are the first ``keys`` columns."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for column in batch.columns[:keys]:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def scored(points: Points, keys: int, batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The units with hits of batches whose rows are sorted by chunk.

    Rows have the chunk's columns, then element, start, times, line and mask.
    A unit's hits are a list, which Spark turns into rows faster than it reads them.
    """

    def made(batch: pa.RecordBatch, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[keys:]]
        group, *unit, ends, hits = points.hits(number, *columns)
        if len(group):
            row = pa.array(np.searchsorted(number, group))
            yield pa.RecordBatch.from_arrays([
                *(c.take(row) for c in batch.columns[:keys]), *(pa.array(x.astype(np.int32)) for x in unit),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hits)),
            ], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch
        if held:
            if chunk_numbers(_joined([held[-1].slice(held[-1].num_rows - 1), batch]), keys)[-1] == 0:
                held.append(batch)
                continue
            whole = _joined([*held, batch])
        number = chunk_numbers(whole, keys)
        end = int(np.searchsorted(number, number[-1]))
        if end:
            yield from made(whole.slice(0, end), number[:end])
        held = [whole.slice(end)]
    if held:
        whole = _joined(held)
        yield from made(whole, chunk_numbers(whole, keys))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
