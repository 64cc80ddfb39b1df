"""BPE against the public library, and leaks against all-pairs edit distance."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filingmill.llm import bpe, decontam

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases():
    rng = random.Random(3)
    bits = ["a", "the", "in", "'s", "'LL", " ", "\n", "é", "É", "ß", "Σ", "İ", "<|endoftext|>",
            "<|startoftext|>", "<|", "1", "%%", "ǅ", "́", "漢", "🙂", " "]
    yield from ("", " ", None, "ΑΣ ΑΣ", "a" * 9000, "don't we'll")
    for _ in range(400):
        yield "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
    yield "".join(rng.choice("abcdeinorstha") for _ in range(20_000))
    yield " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 12))) for _ in range(30_000))


def test_ids_and_pieces_match_the_library(spark, library):
    texts = list(cases())
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    pieces = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    sums = {r.doc_id: r for r in bpe.digests(docs, PATH, with_ids=True).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want == sums[i].ids and sums[i].n_tokens == len(want)
        assert pieces[i].pieces == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_transducer_in_any_steps(library):
    v = bpe.encoder(PATH).v
    rng = random.Random(5)
    word = "".join(rng.choice(["the", "ing", "a", "er", "qz"]) for _ in range(3000))
    want = library.encode(word, add_special_tokens=False).ids
    for step in (1, 7, 1000, len(word)):
        run, got, most = bpe.Transducer(v), [], 0
        for at in range(0, len(word), step):
            got += run.push(word[at:at + step].encode())
            most = max(most, len(run.held))
        assert got + run.finish() == want and most <= run.window + 1


def test_lookahead_of_a_small_list():
    # a b -> ab (0), c a -> ca (1), d c -> dc (2): a new b after "dca" undoes ca and makes dc.
    size = {1: 1, 2: 1, 3: 1, 4: 1, 12: 2, 31: 2, 43: 2}
    assert bpe.sufficient_lookahead([(1, 2, 12), (3, 1, 31), (4, 3, 43)], size) >= 3


def test_text_decoding_waits_for_bytes():
    e = bpe.encoder(PATH)
    assert "".join(bpe.decoded_text(e.v, e.ids("Zoë 漢字 🙂!"))) == "zoë 漢字 🙂!".replace("🙂!", "🙂! ")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def least_edits(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(cost[j - 1] + (w != t), cost[j] + 1, row[j - 1] + 1))
        cost = row
    return min(cost)


def leak_tables(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 30
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(12, 50)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (93, "zzz"), (94, items[0][1])]
    docs = []
    for i in range(120):
        body = text(rng.randrange(0, 200))
        if i % 2:
            leak = words(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(0, len(leak) // 4)):
                at = rng.randrange(len(leak))
                leak[at:at + 1] = rng.choice([[], ["new"], [leak[at], "new"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() if rng.random() < 0.2 else w for w in leak]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, "a zzz!"), (503, " ".join(text(60_000)) + " " + items[5][1])]
    schema = "doc_id long, text string, item_id long, edits int"
    return spark.createDataFrame([(*d, 1, 1) for d in docs], schema), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_leaks_against_brute_force(spark):
    docs, benchmark, doc_rows, item_rows = leak_tables(spark)
    rows = decontam.leaks(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    want = set()
    for key, text in doc_rows:
        own = words(text)[-300:]
        for item, body in item_rows:
            need = words(body)
            if need and own and least_edits(need, own) <= int(decontam.MAX_EDITS * len(need)):
                want.add((key, item))
    assert set(got) == want
    texts = dict(doc_rows)
    for (key, item), r in got.items():
        span = words(texts[key][r.start:r.end])
        assert least_edits(words(dict(item_rows)[item]), span) == r.edits
    blocks = decontam.leaks(docs, benchmark, block_items=7).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want


@pytest.mark.parametrize("size", [7, 20, 50, 100, 200])
def test_recall_at_the_limit(size):
    rng = random.Random(size)
    new = lambda n: [f"n{rng.getrandbits(60)}" for _ in range(n)]
    items = [new(size) for _ in range(120)]
    block = decontam.Items([(i, " ".join(w)) for i, w in enumerate(items)], decontam.MAX_EDITS, decontam.TARGET_RECALL)
    for kind in ("swap", "insert", "drop"):
        missed = 0
        for i, item in enumerate(items):
            text = list(item)
            for at in sorted(rng.sample(range(size), block.allowed[i]), reverse=True):
                text[at:at + (kind != "insert")] = [] if kind == "drop" else new(1)
            body = decontam.word_ids(" ".join(new(size + 3 + i % 9) + text + new(size + 3)))
            missed += i not in {found for found, *_ in block.leaks(body)}
        assert missed == 0, kind


def test_pieces_leave_one_within_its_edits():
    for size in range(1, 120):
        for allowed in {0, size // 10, size // 5, size // 2}:
            parts = decontam.pieces(size, allowed)
            assert [p[0] for p in parts] + [size] == [0] + [p[0] + p[1] for p in parts]
            assert sum(edits + 1 for *_, edits in parts) > allowed


def test_leaks_empty_tables(spark):
    docs, benchmark, _, _ = leak_tables(spark)
    assert decontam.leaks(docs.limit(0), benchmark).collect() == []
    assert decontam.leaks(docs, benchmark.limit(0)).collect() == []
