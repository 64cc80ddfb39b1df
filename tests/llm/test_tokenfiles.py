"""Token files against the public library, in any order, and broken."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from filingmill.llm import tokenfiles
from filingmill.llm.common import work_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (5, "Plain words, it's 42."), (None, "no key"), (2, None), (3, ""), (1, " \n"), (5, "a second five"),
    (7, "Ünïcode Ñ × ÷ ÿ ß J̌ ẛ̣ 字 😀 İ \x1c\x85 x"),
    (6, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b"), (4, "word " * 40_000), (9, "x" * 30_000),
    (7, "Plain words, it's 42."), (5, "Plain words, it's 42."),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def wanted(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def table(spark, rows):
    return spark.createDataFrame(
        [(k, t, 1, "y") for k, t in rows], "doc_id long, text string, row long, file string"
    )


def written(spark, rows, **options):
    path = work_folder(spark, "tokens")
    tokenfiles.write_records(table(spark, rows).coalesce(1), path, VOCABULARY, end_id=1, **options)
    return path


def test_files_hold_the_librarys_ids(spark, library):
    path = written(spark, ODD, file_bytes=20_000)
    assert len([f for f in os.listdir(f"{path}/records") if f.startswith("part-")]) > 3
    rows = tokenfiles.read_records(spark, path).orderBy("start").collect()
    start = 0
    # Keys ascend, null first; rows of one key keep their order.
    for row, (key, text) in zip(rows, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = wanted(library, text)
        assert (row.doc_id, row.start, row.problem) == (key, start, None)
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)


def test_long_texts_are_cut_at_white_space(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PIECE_BYTES", 40)
    run = tokenfiles.Encoder(VOCABULARY)
    texts = [t or "" for _, t in ODD]
    for text, ids in zip(texts, run.texts(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == wanted(library, text)[:-1]


def test_a_vocabulary_that_keeps_white_space(library):
    run = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not run.split
    text = "  two  spaces\n\nand lines "
    assert np.frombuffer(run.texts(pa.array([text]))[0], "<u2").tolist() == own.encode(text).ids


def test_shuffled_reads_by_the_index(spark):
    path = written(spark, ODD, file_bytes=20_000)
    plain = tokenfiles.read_records(spark, path).collect()
    orders = []
    for seed in (1, 2, 1):
        rows = tokenfiles.read_shuffled(spark, path, seed).collect()
        assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((r.doc_id or 0, r.ids) for r in plain)
        orders.append([(r.doc_id, zlib.crc32(r.ids)) for r in rows])
    assert orders[0] == orders[2] != orders[1]


def test_empty_table(spark):
    path = written(spark, [])
    assert tokenfiles.read_records(spark, path).collect() == []
    assert tokenfiles.read_shuffled(spark, path, 1).collect() == []


def test_broken_frames():
    ids = np.arange(5, dtype="<u2").tobytes()
    good = [tokenfiles.frame(k, ids, 2) + b"\n" for k in (1, None, 3)]
    whole = b"".join(good)
    assert [tokenfiles.key_and_ids(p)[0] for _, _, p, _ in tokenfiles.frames_of(whole)] == [1, None, 3]
    bad_payload = whole[:len(good[0]) + 20] + b"\xff" + whole[len(good[0]) + 21:]
    assert [w for *_, w in tokenfiles.frames_of(bad_payload)] == [None, "payload differs from its checksum", None]
    bad_length = b"\xff" + whole[1:]
    assert [w for *_, w in tokenfiles.frames_of(bad_length)] == ["length differs from its checksum"]
    for cut in range(1, len(whole)):
        found = list(tokenfiles.frames_of(whole[:cut]))
        assert sum(length for _, length, _, _ in found) == cut
        assert all(w is None for *_, w in found[:-1])
