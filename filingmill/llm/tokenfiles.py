"""Token ids in length-delimited binary files with an offset index.

A file is a run of frames. A frame is the payload's length (8 bytes), the
masked checksum of those bytes (4), the payload, its masked checksum (4) and a
line feed; numbers are little-endian. A payload is a byte that says whether
there is a key, the key (8 bytes), the bytes per id (1) and the ids. Files
follow each other in ascending key order, so file numbers and offsets give the
place of every id of the whole corpus. The index, written apart from the
records, has one row per frame: its file, place, offset, length, key, number of
ids and the ids before it in its file. With it, frames can be read in any order.

Texts are encoded by the ``tokenizers`` library. Where the vocabulary file
drops white space between words, what stands between ASCII white space is
encoded on its own, with the same ids, once per batch.

Defined results: a null or empty text has the end id alone. Null keys come
first; rows that share a key follow each other in the order of the input, each
a frame of its own. Extra columns are ignored. An empty table gives no frames.
Reading never fails on broken files: a frame whose payload does not match its
checksum has ``problem`` set and no ids; after a broken or cut length the rest
of the file is one row with ``problem`` set.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingmill.llm.bpe import byte_letters
from filingmill.llm.common import batches_of, slices, text_of

#: Bytes of text whose ids go into one file, on average.
FILE_BYTES = 32 << 20
#: Text that is encoded at once, in bytes.
BATCH_BYTES = 6 << 20
#: A longer text is encoded in parts.
PIECE_BYTES = 4 << 20
#: Strings in each half of a worker's memo, and the longest of them.
MEMO_STRINGS, MEMO_CHARS = 150_000, 64
#: Most files whose starts (two numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 1_000_000

_SPACE = re.compile(r"[\x09-\x0d\x20]")
_PLAIN = re.compile(r"[!-~\u00C0-\u00FF]*")
_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<?qB")
_SUM = struct.Struct("<I")


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted, so that sums of stored sums differ."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    """One frame without its line feed."""
    payload = _KEY.pack(key is not None, key or 0, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def frames_of(content: bytes | pa.Buffer) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """Offset, length, payload and what is wrong of each frame of a file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if at + _HEAD.size > len(view):
            yield at, len(view) - at, None, "frame cut short"
            return
        size, check = _HEAD.unpack_from(view, at)
        if masked(view[at:at + 8]) != check:
            yield at, len(view) - at, None, "length differs from its checksum"
            return
        length = _HEAD.size + size + _SUM.size + 1
        if at + length > len(view) or size < _KEY.size:
            yield at, len(view) - at, None, "frame cut short"
            return
        payload = view[at + _HEAD.size:at + _HEAD.size + size]
        good = masked(payload) == _SUM.unpack_from(view, at + length - 5)[0]
        yield at, length, bytes(payload) if good else None, None if good else "payload differs from its checksum"
        at += length


def key_and_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The key and the ids, as 32-bit numbers, of a payload."""
    has_key, key, width = _KEY.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_KEY.size)
    return key if has_key else None, ids.astype("<u4", copy=False)


def drops_space(data: dict) -> bool:
    """Whether ids never depend on what stands beyond ASCII white space.

    ``data`` is the content of a vocabulary file.
    """
    steps = data.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = (first.get("pattern") or {}).get("Regex") if first.get("type") == "Split" else None
    if pattern is None or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    blank = regex.compile(pattern).search(" \t\n\x0b\f\r") is None
    return blank and not any(re.search(r"\s", t["content"]) for t in data["added_tokens"])


class Encoder:
    """Texts to packed ids with the library, a batch of texts at a time.

    Where the vocabulary allows it, texts are split at ASCII white space and
    only the different strings of a batch are looked up. Strings of ASCII and
    Latin-1 letters, whose normal form is plain, go straight to the library's
    merges; all others go through the whole library.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(vocabulary, encoding="utf-8") as file:
            data = json.load(file)
        self.split = drops_space(data)
        steps = [s["type"] for s in (data["normalizer"] or {}).get("normalizers", [])]
        after = [s["type"] for s in (data["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: NFC, white space, lower case, then bytes: the plain way is known.
        self.plain = self.split and steps == ["NFC", "Replace", "Lowercase"] and after == ["Split", "ByteLevel"]
        if self.plain:
            self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = re.compile("|".join(re.escape(t["content"]) for t in data["added_tokens"]) or "(?!)")
            self.letters = dict(enumerate(byte_letters()))
            self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def string(self, text: str) -> bytes:
        """The ids of one string."""
        if not self.plain or not _PLAIN.fullmatch(text) or self.special.search(text):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        ids: list[int] = []
        text = text.lower()
        for word in (text,) if text.isalpha() else self.words.findall(text):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(word)]
        return self._packed(ids)

    def found(self, strings: list[str]) -> list[bytes]:
        """The ids of strings; the younger half of what was seen is kept."""
        young, old, out = self.young, self.old, []
        for s in strings:
            ids = young.get(s)
            if ids is None:
                ids = old.get(s)
                if ids is None:
                    ids = self.string(s)
                if len(s) <= MEMO_CHARS:
                    young[s] = ids
                    if len(young) >= MEMO_STRINGS:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
            out.append(ids)
        return out

    def pieces(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text of a batch."""
        if not self.split:
            return [self.string(t) if t else b"" for t in texts.to_pylist()]
        if self.plain:
            # The library lowers A-Z anyway; here nothing composes with them.
            far = pc.match_substring_regex(texts, r"[^\x01-\x7f\x{c0}-\x{ff}]|<\|")
            texts = pc.if_else(far, texts, pc.ascii_lower(texts))
        strings = pc.ascii_split_whitespace(texts)
        coded = strings.flatten().dictionary_encode()
        packed = self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.width
        store = np.frombuffer(b"".join(packed), dtype=f"<u{self.width}")
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        first = (np.cumsum(sizes) - sizes)[which]
        ids = store[np.arange(total) + np.repeat(first - (ends - counts), counts)]
        edges = np.concatenate([[0], ends])[strings.offsets.to_numpy() - strings.offsets[0].as_py()]
        return [ids[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of whole texts; long ones are cut at white space."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if not self.split or not len(sizes) or sizes.max() <= PIECE_BYTES:
            return self.pieces(texts)
        out: list[bytes] = []
        start = 0
        for i in [*np.flatnonzero(sizes > PIECE_BYTES), len(sizes)]:
            if i > start:
                out += self.pieces(texts.slice(start, i - start))
            if i < len(sizes):
                parts = [self.pieces(pa.array([p]))[0] for p in cut_text(texts[i].as_py())]
                out.append(b"".join(parts))
            start = i + 1
        return out


def cut_text(text: str) -> Iterator[str]:
    """Parts of a text that end before white space."""
    start = 0
    while start < len(text):
        found = _SPACE.search(text, min(start + PIECE_BYTES, len(text)))
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(vocabulary)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``BATCH_BYTES`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def cut_batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``BATCH_BYTES`` bytes of text."""
    ends = np.cumsum(pc.binary_length(rows.column(1)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // BATCH_BYTES, prepend=0, append=-1))
    start = 0
    for end in np.unique(np.append(cuts, rows.num_rows)):
        if end > start:
            yield rows.slice(start, end - start)
            start = int(end)


def write_records(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None,
    file_bytes: int = FILE_BYTES, key: str = "doc_id", text: str = "text",
) -> None:
    """Write a frame per row of ``docs`` in key order, and the index.

    Rows are dealt by key ranges; the row's number in the input lets ranges
    end inside a key that many rows share.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        text_of(text).alias("body"),
        F.monotonically_increasing_id().alias("row"),
    )
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(text)) + 1), F.lit(0))).first()[0]
    order = [F.col("key").asc_nulls_first(), F.col("row").asc()]
    dealt = rows.repartitionByRange(total // file_bytes + 1, *order).sortWithinPartitions(*order)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(vocabulary)
        end = b"" if end_id is None else end_id.to_bytes(run.width, "little")
        for rows in gathered(batches):
            for own in cut_batch(rows):
                found = run.texts(own.column(1))
                held = [frame(k, ids + end, run.width) for k, ids in zip(own.column(0).to_pylist(), found)]
                for few in slices(held, 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(held[few.start:few.stop], pa.binary())], ["value"])
        pa.default_memory_pool().release_unused()

    lines = dealt.select("key", "body").mapInArrow(framed, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/records")
    _scan(spark, path, with_ids=False).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Number and content of each file of records."""
    files = spark.read.format("binaryFile").load(f"{path}/records")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return files.select(number.alias("file"), "content")


_INDEX = "file int, place long, offset long, length long, key long, n_tokens long, before long, problem string"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _scan(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """One row per frame of all files, with the ids if asked for."""
    names = [f.split()[0] for f in _INDEX.split(", ")] + ["ids"] * with_ids
    kinds = _KINDS + [pa.binary()] * with_ids

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size, before = [], 0, 0
                for place, (offset, length, payload, problem) in enumerate(frames_of(content.as_buffer())):
                    own = count = ids = None
                    if payload is not None:
                        own, ids = key_and_ids(payload)
                        count = len(ids)
                    tail = (None if ids is None else ids.tobytes(),) if with_ids else ()
                    held.append((number, place, offset, length, own, count, before, problem, *tail))
                    before += count or 0
                    size += length if with_ids else 100
                    if size > 1 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)
        pa.default_memory_pool().release_unused()

    return _files(spark, path).mapInArrow(run, _INDEX + ", ids binary" * with_ids)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, start, ids (32-bit little-endian numbers) and problem of each frame.

    ``start`` counts the ids of all frames before, in file order. A file's own
    start comes from the index, as one number per file.
    """
    batches_of(spark)
    sizes = read_index(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row per file: its number of ids.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if sizes.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return _scan(spark, path, with_ids=True).join(starts, "file").select(
        F.col("key").alias(key), (F.coalesce("base", F.lit(0)) + F.col("before")).alias("start"), "ids", "problem"
    )


def read_shuffled(spark: SparkSession, path: str, seed: int, key: str = "doc_id") -> DataFrame:
    """The frames in an order that the seed decides, by the index.

    The index alone is shuffled; each file gets the list of frames to cut out
    of it. Returns ``draw`` (the place in the order is that of this number),
    the key, the ids and ``problem``.
    """
    batches_of(spark)
    wanted = read_index(spark, path).where("n_tokens IS NOT NULL").select(
        "file", F.struct(F.xxhash64(F.lit(seed), "file", "offset").alias("draw"), "offset", "length").alias("cut")
    ).groupBy("file").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    names, kinds = ["draw", key, "ids", "problem"], [pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, cuts in zip(batch.column(0), batch.column(1)):
                data, held, size = content.as_py(), [], 0
                for cut in cuts.as_py():
                    part = data[cut["offset"]:cut["offset"] + cut["length"]]
                    _, length, payload, problem = next(frames_of(part))
                    own, ids = key_and_ids(payload) if payload is not None else (None, None)
                    held.append((cut["draw"], own, None if ids is None else ids.tobytes(), problem))
                    size += length
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    rows = _files(spark, path).join(wanted, "file").select("content", "cuts")
    return rows.mapInArrow(run, f"draw long, {key} long, ids binary, problem string").orderBy("draw")
