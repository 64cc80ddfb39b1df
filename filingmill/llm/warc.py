"""WARC archives: writing with segmentation, and reading back whole records.

A record block longer than ``SEGMENT_BYTES`` is cut into a first segment and
continuation records. The reader takes the records of all archives, groups the
segments by origin id, orders them by number, verifies the numbers and the
total length, joins them and decodes the chunked transfer framing. Equal
payloads are stored once: the largest key is the response, the others are
revisits that carry its digest and length.

Writing goes through Spark's text sink: records are its lines, and the two line
ends after a record are its separator, so the files are plain WARC. They are
gzip-compressed. Reading takes one archive per row, which the number of records
per file and the segment size bound; archives with one gzip member per record,
or without compression, are read too.

Defined results: a null payload is empty, and all empty payloads are equal. A
null key is written as ``null`` and never beats another key. A key that occurs
on several rows gets the row's number in its record ids, and each row has a
record; rows repeated with the largest key are all responses. Broken records
come out with ``problem`` set and no payload. An empty table writes an archive
folder without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.llm.common import batches_of, stored, text_of

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 1000
PARTS = 64
URN = "urn:filingmill:page:"
_HEX, _NUMBER = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(r"[0-9]{1,9}")

RAW_SCHEMA = (
    "record_id string, record_type string, segment int, origin string, "
    "total long, target_uri string, payload_digest string, refers_to string, "
    "block binary, problem string"
)
READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, "
    "payload binary, payload_bytes long, payload_digest string, "
    "refers_to string, problem string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for start in range(0, len(payload), size):
        part = payload[start:start + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without line end")
        digits = body[at:end].split(b";")[0].strip()
        if not _HEX.fullmatch(digits):
            raise ValueError("chunk size is no number")
        size = int(digits, 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at:at + size])
        at += size + 2


def _head(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], "", ""]
    return "\r\n".join(lines).encode()


def record_lines(
    record_id: str, uri: str, payload: bytes, refers_to: str | None,
    segment_bytes: int,
) -> Iterator[bytes]:
    """The WARC records of one payload, without the line ends after each."""
    uri = re.sub(r"[\r\n]+", " ", uri)
    base = [
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
    ]
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = start + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _head([
            ("WARC-Type", "revisit"), *base,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{refers_to}>"),
            ("Content-Length", str(len(block))),
        ]) + block
        return
    block = start + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _head([("WARC-Type", "response"), *base, ("Content-Length", str(len(block)))]) + block
        return
    count = -(-len(block) // segment_bytes)
    for number in range(1, count + 1):
        part = block[(number - 1) * segment_bytes:number * segment_bytes]
        length = ("Content-Length", str(len(part)))
        if number == 1:
            yield _head([
                ("WARC-Type", "response"), *base,
                ("WARC-Segment-Number", "1"), length,
            ]) + part
            continue
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == count else []
        yield _head([
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<{record_id}:{number}>"),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Target-URI", uri),
            ("WARC-Segment-Origin-ID", f"<{record_id}>"),
            ("WARC-Segment-Number", str(number)), *last, length,
        ]) + part


def special_roles(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of revisits with what they refer to, and keys of several rows.

    Groups of equal payloads are gathered in parts first, so a hot group is
    spread; only digests and keys are shuffled.
    """
    narrow = stored(
        pages.select(
            F.col(key).alias("page"), F.sha1(text_of(payload)).alias("digest")
        ).withColumn("spot", F.concat("digest", F.lit(":"), F.pmod(F.xxhash64("page"), F.lit(PARTS)))),
        "payload-digests",
    )
    parts = narrow.groupBy("spot").agg(F.max("page").alias("top")).withColumn(
        "digest", F.substring_index("spot", ":", 1)
    )
    tops = parts.groupBy("digest").agg(F.max("top").alias("top"))
    spots = parts.select("spot", "digest").join(tops, "digest").select("spot", F.col("top"))
    counts = narrow.groupBy("page").agg(F.count(F.lit(1)).alias("rows"))
    revisits = narrow.join(spots, "spot").where(
        ~F.col("page").eqNullSafe(F.col("top"))
    ).select("page", "digest", "top", F.lit(1).alias("rows"))
    several = counts.where("rows > 1").join(
        narrow.select(F.col("page").alias("p"), "digest").distinct(),
        F.col("page").eqNullSafe(F.col("p")),
    ).select("page", "digest", F.lit(None).cast("long").alias("top"), "rows")
    return revisits.unionByName(several).groupBy(
        F.col("page").alias("_page"), F.col("digest").alias("_digest")
    ).agg(F.max("top").alias("_top"), F.max("rows").alias("_rows"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url",
    payload: str = "html", segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one record per row of ``pages``, cut into segments if long."""
    batches_of(pages.sparkSession)
    roles = special_roles(pages, key, payload)
    rows = pages.select(
        F.col(key).alias("page"),
        text_of(url).alias("url"),
        F.encode(text_of(payload), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1("payload"))
    rows = rows.join(
        roles,
        rows["page"].eqNullSafe(roles["_page"]) & (rows["digest"] == roles["_digest"]),
        "left",
    ).select("page", "url", "payload", "row", "_top", "_rows")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, uri, body, row, top, copies = (c[i].as_py() for c in columns)
                name = "null" if page is None else str(page)
                if (copies or 1) > 1:
                    name = f"{name}:{row:x}"
                target = None if top is None else f"{URN}{top}"
                for line in record_lines(f"{URN}{name}", uri, body, target, segment_bytes):
                    held.append(line)
                    size += len(line)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    lines = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    (
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def inflated(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive, whatever its number of gzip members.

    Of a broken archive, what comes before the break, and what is wrong.
    """
    if content[:2] != b"\x1f\x8b":
        return content, None
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error as wrong:
            return b"".join(out), f"gzip: {wrong}"
        if not member.eof:
            return b"".join(out), "gzip: cut short"
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out), None


def number(value: str | None) -> int | None:
    """A field's number; null if there is none."""
    return int(value) if value is not None and _NUMBER.fullmatch(value) else None


def split_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields, block and what is wrong of each record of an archive.

    After a length that is no number, reading goes on at the next header.
    """
    at = 0
    while True:
        at = content.find(b"WARC/", at)
        if at < 0:
            return
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, b"", "no end of the record header"
            return
        fields = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length, problem = number(fields.get("content-length", "0")), None
        if length is None:
            length, problem = 0, "content length is no number"
        elif end + 4 + length > len(content):
            problem = "record cut short"
        elif "warc-segment-number" in fields and number(fields["warc-segment-number"]) is None:
            problem = "segment number is no number"
        yield fields, content[end + 4:end + 4 + length], problem
        at = end + 4 + length


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of all archives under ``path``, segments unjoined."""
    names = [f.split()[0] for f in RAW_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(),
             pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def bare(value: str | None) -> str | None:
        return None if value is None else value.strip("<>")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                whole, broken = inflated(content.as_py())
                if broken:
                    rows.append((None, "", None, None, None, None, None, None, b"", broken))
                for f, block, problem in split_records(whole):
                    rows.append((
                        bare(f.get("warc-record-id")), f.get("warc-type", ""),
                        number(f.get("warc-segment-number")),
                        bare(f.get("warc-segment-origin-id")),
                        number(f.get("warc-segment-total-length")),
                        f.get("warc-target-uri"), f.get("warc-payload-digest"),
                        bare(f.get("warc-refers-to")), block, problem,
                    ))
                    size += len(block)
                    if size > 1 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RAW_SCHEMA)


def decoded(
    kind: str, block: bytes, digest: str | None
) -> tuple[bytes | None, int | None, str | None, str | None]:
    """Payload, its length and digest, and what is wrong with a whole block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, None, None, "no end of the HTTP header"
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    want = digest.removeprefix("sha1:") if digest else None
    if kind == "revisit":
        length = fields.get("content-length")
        if length is not None and number(length) is None:
            return None, None, want, "content length is no number"
        return None, number(length), want, None
    if fields.get("transfer-encoding", "").lower() == "chunked":
        try:
            body = unchunked(body)
        except ValueError as wrong:
            return None, None, None, f"chunk framing: {wrong}"
    have = payload_digest(body)
    if want and want != have:
        return None, None, None, "payload digest differs"
    return body, len(body), have, None


def joined(segments: list[tuple[int, bytes]], total: int | None) -> tuple[bytes | None, str | None]:
    """The whole block of sorted segments, or what is wrong with them."""
    numbers = [n for n, _ in segments]
    if len(set(numbers)) < len(numbers):
        return None, "segment repeated with another content"
    if numbers != list(range(1, len(numbers) + 1)) or total is None:
        return None, "segment missing"
    block = b"".join(b for _, b in segments)
    if len(block) != total:
        return None, f"segments have {len(block)} of {total} bytes"
    return block, None


def reassembled(raw: DataFrame) -> DataFrame:
    """Whole records with decoded payloads.

    Only segments are shuffled, and one group is the segments of one record.
    """
    whole = raw.where(F.col("segment").isNull() & (F.col("record_type") != "continuation"))
    parts = raw.where(F.col("segment").isNotNull() | (F.col("record_type") == "continuation"))
    first = F.col("segment") == 1
    grouped = parts.withColumn("record", F.coalesce("origin", "record_id")).groupBy("record").agg(
        F.max(F.when(first, F.col("record_type"))).alias("record_type"),
        F.max(F.when(first, F.col("target_uri"))).alias("target_uri"),
        F.max(F.when(first, F.col("payload_digest"))).alias("payload_digest"),
        F.max(F.when(first, F.col("refers_to"))).alias("refers_to"),
        F.max("total").alias("total"), F.max("problem").alias("problem"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("segments"),
    )
    names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "total", "segments", "problem"]
    one = F.array(F.struct(F.lit(None).cast("int").alias("segment"), F.col("block")))
    rows = whole.select(
        *names[:5], F.lit(None).cast("long").alias("total"), one.alias("segments"), "problem"
    ).unionByName(grouped.withColumnRenamed("record", "record_id").select(*names))
    out_names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(),
             pa.string(), pa.string(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(i) for i in range(8)]
            for i in range(batch.num_rows):
                rid, kind, uri, digest, refers, total, segments, problem = (c[i].as_py() for c in columns)
                parts = [(s["segment"], s["block"]) for s in segments]
                block = b""
                if problem is not None:
                    pass
                elif parts[0][0] is None and len(parts) == 1:
                    block = parts[0][1]
                else:
                    block, problem = joined(parts, total)
                body = length = have = None
                if problem is None:
                    body, length, have, problem = decoded(kind, block, digest)
                out.append((rid, kind, uri, body, length, have, refers, problem))
                size += len(body or b"")
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], out_names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], out_names)

    return rows.mapInArrow(decode, READ_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, whole and decoded."""
    batches_of(spark)
    return reassembled(raw_records(spark, path))


def page_of(record_id: str):
    """The key inside a record id, null if it is none."""
    name = F.split(F.regexp_replace(F.col(record_id), f"^{URN}", ""), ":")
    return F.get(name, F.lit(0)).try_cast("long")
