"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = 5
#: A factor for each place of a shingle.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

# Bytes with A-Z as a-z, plus one so that no byte is zero; 0 ends a word.
_LOWERED = np.arange(1, 257, dtype=np.uint16)
_LOWERED[ord("A"):ord("Z") + 1] += 32
#: Words end at ASCII white space alone.
SPACED = _LOWERED.copy()
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
#: Words are runs of ASCII letters and digits and of other characters.
LETTERS = np.where([chr(i).isalnum() or i > 127 for i in range(256)], _LOWERED, 0).astype(np.uint16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a number, as many as were ever asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, count: int) -> np.ndarray:
        if len(self.known) < count:
            new = np.full(count * 5 // 4, self.base, dtype=np.uint64)
            new[0] = 1
            self.known = np.multiply.accumulate(new)
        return self.known[:count]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


def word_spans(
    texts: list[str], table: np.ndarray = SPACED
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, each text's first word, and spans.

    The second array has one more entry than texts. Spans are bytes from the
    start of the first text, with one byte between texts. A hash is a
    polynomial in the bytes modulo 2^64, mixed.
    """
    parts = [t.encode(errors="surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    code = table[raw]
    if table is LETTERS:
        _blank_marks(raw, code)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.concatenate([[False], code > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * _UP.upto(len(code)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _DOWN.upto(len(code) + 1)[starts])
    return hashes, np.searchsorted(starts, begins), starts, ends


def _blank_marks(raw: np.ndarray, code: np.ndarray) -> None:
    """Clear the marks at U+00A0-00BF, U+2000-206F and U+3000-303F."""
    two = np.flatnonzero(raw[:-1] == 0xC2)
    two = two[raw[two + 1] < 0xC0]
    lead = np.flatnonzero((raw[:-2] == 0xE2) | (raw[:-2] == 0xE3))
    lead = lead[(raw[lead + 1] == 0x80) | ((raw[lead] == 0xE2) & (raw[lead + 1] == 0x81))]
    for at in (two, two + 1, lead, lead + 1, lead + 2):
        code[at] = 0


def word_hashes(
    texts: list[str], table: np.ndarray = SPACED
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first word."""
    return word_spans(texts, table)[:2]


def shingle_hashes(
    words: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles and each text's first shingle.

    A text of fewer words, but one at least, has its whole sequence as one.
    """
    counts = np.diff(first)
    total = len(words)
    padded = np.concatenate([words, np.zeros(_SHINGLE, dtype=np.uint64)])
    full = np.zeros(total, dtype=np.uint64)
    for k in range(_SHINGLE):
        full += padded[k:k + total] * _PLACE[k]
    per = np.where(counts >= _SHINGLE, counts - _SHINGLE + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], per)
    out = full[at]
    for i in np.flatnonzero((counts > 0) & (counts < _SHINGLE)):
        own = words[first[i]:first[i + 1]]
        out[begin[i]] = (own * _PLACE[:len(own)]).sum() + np.uint64(len(own))
    return mix(out), begin


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, begin = shingle_hashes(*word_hashes(texts))
    for i in range(len(texts)):
        yield np.unique(values[begin[i]:begin[i + 1]])
