"""Chat formatting, archives and shards: exact round trips and odd rows."""

import gzip
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filingmill.llm import chat, shards, warc
from filingmill.llm.common import work_folder

TURNS = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["", "<|im_end|>", "<|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<", "|", "<|", "a\nb", "\\n<\\n", None]


def turned(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def read(spark, rows):
    texts = chat.format_records(chat.blocks_of_turns(turned(spark, rows), block=4), "conv_id", "part")
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(texts, "conv_id").collect()}


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 14)):
            text = None if rng.random() < 0.1 else "".join(rng.choice([n for n in NASTY if n]) for _ in range(rng.randrange(4)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we\nird<|", None]), text))
    rows += [(100, 0, "user", "q"), (100, 1, "assistant", "x" * 200_000), (101, 0, "user", "q"), (101, 1, "assistant", "r")]
    rows += [(102, 0, "system", "s"), (102, 1, "user", "q"), (102, 2, "assistant", "a")]
    rows += [(103, 0, "user", "b"), (103, 0, "user", "a"), (103, 0, "user", "a"), (103, None, "user", "first")]
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert read(spark, rows) == want


def test_chat_no_control_inside_texts(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(NASTY)]
    text = chat.format_records(chat.blocks_of_turns(turned(spark, rows)), "conv_id", "part").first().formatted
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(rows)
    assert read(spark, []) == {}


def test_fingerprints_select_mappings(spark):
    records = spark.createDataFrame(
        [
            (1, 0, "p", "c", None, None, None, None, None),
            (2, 0, None, None, "i", "x", "o", None, None),
            (3, 0, None, None, None, None, None, [("user", "hi")], None),
            (4, 0, None, None, None, None, None, None, [("human", None)]),
            (5, 0, "p", None, "i", None, None, None, None),
        ],
        "k long, part long, " + chat.RECORD_SCHEMA,
    )
    got = {r.k: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_turns(records, ("k", "part")).collect()}
    assert got == {
        1: [("user", "p"), ("assistant", "c")],
        2: [("system", "i"), ("user", "x"), ("assistant", "o")],
        3: [("user", "hi")], 4: [("human", "")], 5: None,
    }
    assert [r.k for r in chat.unmapped(records, "k", "part").collect()] == [5]


PAGES = "page_id long, url string, html string, digest string, row long"


def archive(spark, rows, **options):
    path = work_folder(spark, "test-warc")
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    warc.write_archives(docs, path, **options)
    return path, warc.read_archives(spark, path).collect()


def test_warc_round_trip(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("añb\r\n<€𝄞WARC/1.1 ") for _ in range(90_000))
    pages = [
        (1, "http://a/", "same"), (4, "http://b/", "same"), (2, "u", None), (3, "u\r\nx", ""), (5, None, big),
        (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (7, "u", "x" * 40_000), (None, "n", "same"),
        (8, "u", big + "."), (8, "u", "other"), (9, "u", "twice"), (9, "u", "twice"),
    ]
    _, rows = archive(spark, pages, records_per_file=3)
    assert len(rows) == len(pages) and all(r.problem is None for r in rows)
    top = {}
    for page, _, body in pages:
        if page is not None:
            top[body or ""] = max(top.get(body or "", -1), page)
    want = Counter()
    for page, _, body in pages:
        raw = (body or "").encode()
        first = page == top[body or ""]
        want[(page, len(raw), warc.payload_digest(raw), "response" if first else "revisit",
              raw if first else None, None if first else top[body or ""])] += 1

    def page_of(name):
        part = name.removeprefix(warc.URN).split(":")[0]
        return None if part == "null" else int(part)

    got = Counter(
        (page_of(r.record_id), r.payload_bytes, r.payload_digest, r.record_type,
         None if r.payload is None else bytes(r.payload), r.refers_to and page_of(r.refers_to))
        for r in rows
    )
    assert got == want


def test_warc_empty_table(spark):
    assert archive(spark, [])[1] == []


def test_warc_finds_broken_segments(spark):
    lines = [warc.record_lines(f"{warc.URN}{i}", "u", bytes([65 + i]) * 100, None, 60) for i in range(3)]
    parts = [list(x) for x in lines]
    del parts[0][1]
    parts[1][1] = parts[1][1].replace(b"BBBB", b"BBB\x00")
    parts[2].reverse()
    path = work_folder(spark, "test-broken")
    raw = b"".join(p + b"\r\n\r\n" for part in parts for p in part)
    members = b"".join(gzip.compress(p + b"\r\n\r\n") for part in parts for p in part)
    assert warc.inflated(members) == (raw, None)
    spark.createDataFrame([(bytearray(raw),)], "b binary").select(F.col("b").cast("string")).write.option(
        "lineSep", "\n").text(path)
    got = {r.record_id[-1]: (r.problem, r.payload) for r in warc.read_archives(spark, path).collect()}
    assert got["0"] == ("segment missing", None)
    assert got["1"] == ("payload digest differs", None)
    assert got["2"][0] is None and bytes(got["2"][1]) == b"C" * 100


def test_shards_law_and_rows(spark):
    rows = [(i % 700 if i % 9 else None, None if i % 50 == 0 else f"t{i % 311}" * (i % 7), "en", i) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long").withColumnRenamed(
        "slot", "number")
    path = work_folder(spark, "test-shards")
    shards.shuffle_to(docs.drop("shard"), path, bucket_bytes=700)
    got = shards.read_shards(spark, path, 8).collect()
    assert Counter((r.doc_id, r.text, r.number) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.number for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) < 5 for a, b in zip(order, order[1:])) < 60
    again = work_folder(spark, "test-shards")
    shards.shuffle_to(docs.drop("shard"), again, bucket_bytes=700)
    assert Counter(map(tuple, shards.read_shards(spark, again, 8).collect())) == Counter(map(tuple, got))
    assert shards.shuffled_shards(docs.drop("shard").limit(0), 8).collect() == []


def test_shards_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_bucket", "_order", "_place", "_rank", "Shard", "slot", "doc_slot", "total", "a.b", "row"]
    rows = [tuple([i, f"t{i}"] + [10 * i + j for j in range(len(names) - 2)]) for i in range(50)]
    docs = spark.createDataFrame(rows, names)
    got = shards.shuffled_shards(docs, 4, bucket_bytes=100)
    want = [*names[:6], "doc_Shard", "doc_doc_slot", "doc_slot", *names[9:]]
    assert got.columns == [*want, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == rows


def test_fisher_yates_is_uniform():
    import numpy as np

    rng = np.random.default_rng(0)
    seen = Counter(tuple(shards.fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def records_of(*records):
    return b"".join(head + b"\r\n\r\n" + block + b"\r\n\r\n" for head, block in records)


@pytest.mark.parametrize("body", [
    b"1\r\nx\r\n-6\r\n", b"zz\r\n", b"\r\n\r\n", b"+1\r\nx\r\n0\r\n\r\n", b"1_0\r\n", b"5\r\nx\r\n", b"",
    b"f" * 40 + b"\r\n",
])
def test_broken_chunks_end(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_malformed_archives_come_out_with_a_problem(spark):
    ok = b"HTTP/1.1 200 OK\r\n\r\nbody"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%s>\r\n%s"
    size = b"Content-Length: %d" % len(ok)
    files = {
        "a": records_of(
            (head % (b"good", size), ok), (head % (b"length", b"Content-Length: many"), ok),
            (head % (b"segment", b"WARC-Segment-Number: one\r\n" + size), ok),
            (head % (b"total", b"WARC-Segment-Number: 1\r\nWARC-Segment-Total-Length: x\r\n" + size), ok),
            (head % (b"last", size), ok),
        ),
        "b": records_of((head % (b"cut", b"Content-Length: 4000"), ok)),
        "c": b"WARC/1.1\r\nno end",
        "d": gzip.compress(records_of((head % (b"zip", size), ok)))[:-30] + b"\xff" * 30,
        "e": gzip.compress(b"x" * 100_000)[:40], "f": b"", "g": b"\x1f\x8b",
        "h": records_of((
            b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:revisit>\r\nContent-Length: 45",
            b"HTTP/1.1 200 OK\r\nContent-Length: lots\r\n\r\n....",
        )),
    }
    folder = work_folder(spark, "broken")
    os.makedirs(folder)
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    rows = {r.record_id: r for r in warc.read_archives(spark, folder).collect() if r.record_id}
    assert {k for k, r in rows.items() if r.problem is None} == {"urn:good", "urn:last"}
    assert {"urn:length", "urn:segment", "urn:total", "urn:cut", "urn:revisit"} <= set(rows)
    assert all(r.payload is None for k, r in rows.items() if r.problem is not None)
    lost = [r.problem for r in warc.read_archives(spark, folder).collect() if not r.record_id]
    assert sum(p.startswith("gzip") for p in lost) == 3 and "no end of the record header" in lost
