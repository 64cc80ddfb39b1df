"""BPE encoding as a streaming transducer, and incremental decoding.

Texts are normalised and split as the vocabulary file says (NFC, white space,
lower case; words, digits, punctuation). A word's symbols enter a transducer
that holds a bounded window. From the merge list follows a sufficient
lookahead: how far to the left the symbols after a point can change tokens.
Tokens further from the window's end than that are stable and are emitted; the
rest waits for more. A final token boundary is never crossed by a merge, so
what follows it is encoded alone with the same result. Words shorter than
the lookahead need no window, and are kept in a bounded memo. Letters newer
than the tokenizer's Unicode tables may be split differently.

Decoding is a state machine. As pieces, it yields the vocabulary strings with
one space between them, which is what a decoder-less tokenizer returns. As
text, it collects the bytes of the pieces, yields characters once their last
byte is there, and a space at each word end.

Defined results: a null or empty text has no ids and decodes to the empty
string. The special strings inside a text are special tokens. Repeated rows are
each encoded; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.llm.common import batches_of

BLOCK_CHARS = 1 << 16
MEMO_WORDS = 300_000
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from 256.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for number, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + number)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A vocabulary file's pieces, merges, special tokens and patterns."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids.update(self.special)
        self.pieces = {i: p for p, i in self.ids.items()}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + END] for c in letters]
        #: Of each pair, the merge's rank and the merged id as one number.
        self.merges: dict[int, int] = {}
        order = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, both = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges[a << 20 | b] = rank << 20 | both
            order.append((a, b, both))
        self.lookahead = sufficient_lookahead(
            order, {i: len(p.removesuffix(END)) for i, p in self.pieces.items()}
        )
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.byte_of = {c: b for b, c in enumerate(letters)}


def sufficient_lookahead(
    merges: list[tuple[int, int, int]], size: dict[int, int]
) -> int:
    """Symbols to the left of a point that what comes after it can change.

    Say a region of changed tokens begins at some place when merge r is due. A
    later merge (u, v) carries the change on over u, if v begins there in one
    of the two runs; then u of the merge before is v or on v's left edge. So
    the reach is the heaviest chain of merges of rising rank in which each
    left part stands on the left edge of the next right part. The longest
    piece is added for the change that starts the chain.
    """
    parts = {both: (a, b) for a, b, both in merges}
    reach: dict[int, int] = {}
    longest = 0
    for a, b, _ in reversed(merges):
        own = size[a] + reach.get(a, 0)
        longest = max(longest, own)
        edge = b
        while True:
            reach[edge] = max(reach.get(edge, 0), own)
            if edge not in parts:
                break
            edge = parts[edge][0]
    return longest + max(size.values())


_NEVER = 1 << 60
_ID = (1 << 20) - 1


def merged(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges, lowest rank first, from the left."""
    get = merges.get
    ranks = [get(a << 20 | b, _NEVER) for a, b in zip(symbols, symbols[1:])]
    while ranks:
        best = min(ranks)
        if best == _NEVER:
            break
        both, at = best & _ID, 0
        while True:
            try:
                at = ranks.index(best, at)
            except ValueError:
                break
            symbols[at:at + 2] = [both]
            del ranks[at]
            if at:
                ranks[at - 1] = get(symbols[at - 1] << 20 | both, _NEVER)
            if at < len(ranks):
                ranks[at] = get(both << 20 | symbols[at + 1], _NEVER)
    return symbols


class Transducer:
    """Encodes one word of any length with a bounded window of symbols."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.v = vocabulary
        self.window = max(window or 0, 2 * vocabulary.lookahead)
        self.held = bytearray()

    def push(self, data: bytes) -> Iterator[int]:
        """Take bytes of the word; yield the ids that have become stable."""
        for start in range(0, len(data), self.window):
            self.held += data[start:start + self.window]
            while len(self.held) > self.window + 1:
                # The last byte stays: it may be the word's end.
                part = self.held[:self.window]
                stable = len(part) - self.v.lookahead
                done = 0
                for token in merged([self.v.inner[b] for b in part], self.v.merges):
                    size = len(self.v.pieces[token])
                    if done + size > stable:
                        break
                    done += size
                    yield token
                del self.held[:done]

    def finish(self) -> list[int]:
        """The ids of what is left, with the word's end."""
        if not self.held:
            return []
        symbols = [self.v.inner[b] for b in self.held[:-1]] + [self.v.last[self.held[-1]]]
        self.held = bytearray()
        return merged(symbols, self.v.merges)


class Encoder:
    """Texts to ids, block by block."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO_WORDS):
        self.v = vocabulary
        self.memo: dict[str, tuple[int, str, str, tuple[int, ...]]] = {}
        self.size = memo

    def word(self, word: str) -> Iterator[int]:
        data = word.encode(errors="surrogatepass")
        if len(data) <= self.v.lookahead:
            inner, last = self.v.inner, self.v.last
            yield from merged([*map(inner.__getitem__, data[:-1]), last[data[-1]]], self.v.merges)
            return
        run = Transducer(self.v)
        yield from run.push(data)
        yield from run.finish()

    def entry(self, word: str) -> tuple[int, str, str, tuple[int, ...]]:
        """Count, ids and pieces as text with spaces between, and ids."""
        found = self.memo.get(word)
        if found is None:
            ids = list(self.word(word))
            found = (
                len(ids), " ".join(map(str, ids)), " ".join(decoded_pieces(self.v, ids)), tuple(ids)
            )
            if len(word) <= 64:
                if len(self.memo) >= self.size:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of normalised words and special strings, by blocks."""
        start = 0
        while start < len(text):
            end = start + BLOCK_CHARS
            while end < len(text) and not text[end - 1].isspace():
                end += 1
            block = text[start:end]
            start = end
            for number, part in enumerate(self.v.cut.split(block) if "<|" in block else (block,)):
                if number % 2:
                    yield [part]
                elif part:
                    yield self.v.words.findall(normalised(part))

    def ids(self, text: str) -> Iterator[int]:
        for words in self.words(text):
            for word in words:
                if word in self.v.special:
                    yield self.v.special[word]
                elif len(word) <= 64:
                    yield from self.entry(word)[3]
                else:
                    yield from self.word(word)

    def digest(self, text: str, found: list[int] | None = None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded pieces.

        The ids are added to ``found`` if it is given.
        """
        count, ids, pieces = 0, hashlib.sha256(), hashlib.sha256()
        get, between = self.memo.get, b""
        for words in self.words(text):
            if not words:
                continue
            if words[0] in self.v.special:
                token = self.v.special[words[0]]
                entries = [(1, str(token), words[0], (token,))]
            else:
                entries = [get(w) or self.entry(w) for w in words]
            n, i, p, numbers = zip(*entries)
            if found is not None:
                found.extend(itertools.chain.from_iterable(numbers))
            count += sum(n)
            ids.update(between + " ".join(i).encode())
            pieces.update(between + " ".join(p).encode())
            between = b" "
        return count, ids.hexdigest(), pieces.hexdigest()


def normalised(text: str) -> str:
    """NFC and lower case, letter by letter (a capital sigma has one form)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def decoded_pieces(vocabulary: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    for token in ids:
        yield vocabulary.pieces[token]


def decoded_text(vocabulary: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Characters as soon as their bytes are complete; a space at word ends."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for token in ids:
        piece = vocabulary.pieces[token]
        if piece in vocabulary.special:
            yield state.decode(b"", True) + piece
            state.reset()
            continue
        ends = piece.endswith(END)
        raw = bytes(vocabulary.byte_of[c] for c in piece.removesuffix(END))
        yield state.decode(raw, ends) + (" " if ends else "")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(Vocabulary(path))


def _over_texts(docs: DataFrame, key: str, text: str, schema: str, row) -> DataFrame:
    """Run ``row`` on each text; it yields the columns after the key."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, start, size = [], 0, 0
            for i, cell in enumerate(batch.column(1)):
                value = cell.as_py() or ""
                done.append(row(value))
                size += len(value)
                if size > 1 << 20 or i == batch.num_rows - 1:
                    columns = [batch.column(0).slice(start, len(done))]
                    columns += [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*done), fields[1:])]
                    yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])
                    done, start, size = [], i + 1, 0

    batches_of(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids of each text."""
    schema = f"{key} long, ids array<int>"
    return _over_texts(docs, key, text, schema, lambda t: (list(encoder(vocabulary).ids(t)),))


def decode(rows: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key, pieces and text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary).v
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py() or []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1),
                     pa.array([" ".join(decoded_pieces(v, own))]),
                     pa.array(["".join(decoded_text(v, own))])],
                    [key, "pieces", "text"],
                )

    return rows.select(F.col(key).cast("long"), ids).mapInArrow(run, f"{key} long, pieces string, text string")


def digests(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Key, number of ids, digests of the ids and of the decoded pieces, and ids if asked for."""
    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not with_ids:
        return _over_texts(docs, key, text, schema, lambda t: encoder(vocabulary).digest(t))

    def row(value: str) -> tuple:
        ids: list[int] = []
        return (*encoder(vocabulary).digest(value, ids), ids)

    return _over_texts(docs, key, text, f"{schema}, ids array<int>", row)
