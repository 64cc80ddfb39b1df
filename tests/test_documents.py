"""Pages, chunks, retrieval and dedupe against plain loops."""

import random

from pyspark.sql import functions as F

from filingmill.operators import chunks as C
from filingmill.operators import dedupe, retrieve

PAGE = "document_id string, company_id string, page_num int, text string"


def pages_of(spark, texts, doc="d"):
    rows = [(doc, "c", i + 1, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, PAGE)
    size = F.length(F.regexp_replace("text", r"\s+", ""))
    return frame.withColumn("char_count", size).withColumn("is_empty", size == 0)


def labels(spark, sizes):
    chunks = C.build_chunks(pages_of(spark, ["x" * n for n in sizes]))
    return [r.chunk_label for r in chunks.orderBy("chunk_index").collect()]


def test_form_feeds(spark):
    schema = "document_id string, company_id string, content string, page_count int"
    rows = spark.createDataFrame([("d", "c", "a\fb\f", 2), ("e", "c", "\fa\f\fb", 1)], schema)
    got = [(r.document_id, r.page_num, r.text) for r in C.split_pages(rows).orderBy("document_id", "page_num").collect()]
    assert got == [("d", 1, "a"), ("d", 2, "b"), ("e", 1, ""), ("e", 2, "a"), ("e", 3, "b")]


def test_page_status(spark):
    cases = [([20, 30], "scanned"), ([0, 100], "partial"), ([30], "complete")]
    for sizes, status in cases:
        stats = C.page_stats(pages_of(spark, ["x" * n for n in sizes]))
        assert stats.collect()[0].extraction_status == status


def test_chunk_labels(spark):
    assert labels(spark, [100] * 4) == ["Pages 1–3", "Page 4"]
    assert labels(spark, [0, 100, 0, 500]) == ["Page 1 (empty)", "Pages 2–3", "Page 4"]
    assert labels(spark, [9000]) == ["Page 1 (part 1/2)", "Page 1 (part 2/2)"]


def test_split_sizes_and_header(spark):
    pages = pages_of(spark, ["x" * 9000])
    headers = spark.createDataFrame([("d", "c", "{meta}")], "document_id string, company_id string, header string")
    rows = C.build_chunks(pages, headers).orderBy("chunk_index").collect()
    assert [(r.chunk_index, len(r.content)) for r in rows] == [(0, 6), (1, 4000), (2, 5000)]
    preview = C.document_preview(pages, C.build_chunks(pages, headers), headers).collect()[0].preview
    assert preview.startswith("{meta}\n\n[PAGE 1 / 1 — preview]\nxxx")
    assert "…\n[CHUNKED — 3 chunks (1 pages)" in preview
    assert len(preview.split("[CHUNKED")[0]) == 5000 - 4 + 2


def loop_chunks(texts):
    """The grouping rule as a plain loop: (first, last, content)."""
    count = [len("".join(t.split())) for t in texts]
    out, i = [], 0
    while i < len(texts):
        if count[i] > 8000:
            rest = texts[i]
            parts = []
            while len(rest) > 8000:
                at = rest.rfind("\n", 0, 4201)
                cut = at + 1 if at > 3500 else 4000
                parts.append(rest[:cut])
                rest = rest[cut:]
            if rest.strip():
                parts.append(rest)
            out += [(i + 1, i + 1, p) for p in parts]
            i += 1
            continue
        j = i + 1
        if 0 < count[i] < 300:
            while j < len(texts) and j - i < 3 and count[j] < 300:
                j += 1
        if j - i > 1:
            body = "\n\n".join(f"[Page {k + 1}]\n{texts[k]}" for k in range(i, j))
            out.append((i + 1, j, body))
        elif count[i] == 0:
            out.append((i + 1, i + 1, f"[Page {i + 1} — no extractable text]"))
        else:
            out.append((i + 1, i + 1, texts[i]))
        i = j
    return out


def test_chunks_match_a_loop(spark):
    rng = random.Random(3)
    documents = {}
    for d in range(25):
        texts = []
        for _ in range(rng.randrange(1, 14)):
            n = rng.choice([0, 0, 10, 50, 120, 299, 300, 900, 8001, 13000, 21000])
            text = "".join(rng.choice("abcdefghij") for _ in range(n))
            for _ in range(n // 700):
                k = rng.randrange(len(text))
                text = text[:k] + "\n" + text[k:]
            texts.append(text.strip())
        documents[f"d{d:02}"] = texts
    frame = None
    for name, texts in documents.items():
        part = pages_of(spark, texts, name)
        frame = part if frame is None else frame.unionByName(part)
    got = {}
    for r in C.build_chunks(frame).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r)
    for name, texts in documents.items():
        rows = got[name]
        assert [r.chunk_index for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.page_start, r.page_end, r.content) for r in rows] == loop_chunks(texts)


CHUNK = "company_id string, document_id string, chunk_index int, page_start int, page_end int, content string"


def test_unit_ids(spark):
    rows = spark.createDataFrame([("c", "d", 4, 1, 1, "a" * 30 + "\n" + "b" * 30)], CHUNK)
    units = retrieve.evidence_units(rows).orderBy("line_start", "size").collect()
    assert [u.unit_id for u in units] == ["4:1-1", "4:1-2", "4:2-2", "4:2-2"]


def test_unit_scores(spark):
    text = "Net debt fell 5% in the year\nPage 7 of the whole report"
    rows = spark.createDataFrame([("c", "d", 1, 1, 1, text)], CHUNK)
    scores = retrieve.lexical_scores(rows, {"s": ["net debt"]}).where("size = 1").collect()
    assert [(s.line_start, s.score) for s in scores] == [(1, 64)]


def loop_select(chunks, queries, limit):
    """The selection rule as a plain loop over one document's chunks."""
    units = []
    for index, content in chunks:
        lines = content.split("\n")
        for i in range(len(lines)):
            for size in (1, 2):
                text = " ".join(x.strip() for x in lines[i:i + size] if x.strip())
                if 24 <= len(text) <= 900:
                    end = min(len(lines), i + size)
                    units.append((f"{index}:{i + 1}-{end}", index, i + 1, text))

    def score(text, query):
        words = text.lower().split()
        total = 60 if query in " ".join(words) else 0
        total += sum(min(8, words.count(t)) for t in query.split() if len(t) > 2)
        return total + (2 if any(c.isdigit() for c in text) else 0)

    chosen, per_chunk = {}, {}

    def add(u):
        if u[0] in chosen or per_chunk.get(u[1], 0) >= 6:
            return
        chosen[u[0]] = u
        per_chunk[u[1]] = per_chunk.get(u[1], 0) + 1

    for q in queries:
        ranked = sorted((u for u in units if score(u[3], q) > 0), key=lambda u: (-score(u[3], q), u[1], u[2]))
        for u in ranked[:4]:
            add(u)
            if len(chosen) >= limit:
                return sorted(chosen)
    total = {id(u): sum(score(u[3], q) for q in queries) for u in units}
    for u in sorted((u for u in units if total[id(u)] > 0), key=lambda u: (-total[id(u)], u[1], u[2])):
        add(u)
        if len(chosen) >= limit:
            break
    return sorted(chosen)


def test_selection_matches_a_loop(spark):
    rng = random.Random(11)
    queries = {"a": ["net debt", "cash flow", "margin"], "b": ["board of nine", "tax"]}
    words = ["net", "debt", "cash", "flow", "margin", "board", "of", "nine", "tax", "lorem", "ipsum", "dolor", "77", "9"]
    rows, documents = [], {}
    for d in range(12):
        chunks = []
        for index in range(1, rng.randrange(2, 9)):
            lines = [
                " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))
                for _ in range(rng.randrange(1, 16))
            ]
            chunks.append((index, "\n".join(lines)))
        documents[f"d{d}"] = chunks
        rows += [("c", f"d{d}", i, i, i, t) for i, t in chunks]
    frame = spark.createDataFrame(rows, CHUNK)
    for limit in (5, 32):
        got = {}
        for r in retrieve.select_evidence(frame, queries, limit).collect():
            got.setdefault((r.document_id, r.section_key), []).append(r.unit_id)
        for name, chunks in documents.items():
            for section, asked in queries.items():
                want = loop_select(chunks, asked, limit)
                assert sorted(got.get((name, section), [])) == want, (name, section, limit)


ITEM = (
    "company_id string, arrival bigint, source_type string, title string, headline string, "
    "original_url string, document_url string"
)


def loop_dedupe(items, seen=()):
    keys, kept = set(seen), []
    for arrival, url, title in items:
        title = " ".join(title.lower().split())
        if url in keys or title in keys:
            continue
        keys |= {url, title}
        kept.append(arrival)
    return kept


def items_frame(spark, items, company="c", kind="news"):
    return spark.createDataFrame(
        [(company, a, kind, t, None, u, None) for a, u, t in items], ITEM
    )


def test_skipped_items_do_not_block(spark):
    items = [(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "T2 ")]
    kept = dedupe.two_key_dedupe(items_frame(spark, items)).where("kept")
    assert sorted(r.arrival for r in kept.collect()) == [1, 3]


def test_dedupe_matches_a_loop(spark):
    rng = random.Random(5)
    frame, want = None, {}
    for company in range(12):
        items = [(i, f"u{rng.randrange(9)}", f"t{rng.randrange(9)}") for i in range(rng.randrange(1, 30))]
        part = items_frame(spark, items, str(company), "news" if company % 2 else "filing")
        frame = part if frame is None else frame.unionByName(part)
        want[str(company)] = loop_dedupe(items, {"u0", "t1"})
    stored = spark.createDataFrame(
        [(str(c), "news" if c % 2 else "document", k) for c in range(12) for k in ("u0", "t1")],
        "company_id string, kind string, k string",
    )
    got = {str(c): [] for c in range(12)}
    for r in dedupe.two_key_dedupe(frame, stored).where("kept").collect():
        got[r.company_id].append(r.arrival)
    assert {c: sorted(v) for c, v in got.items()} == want


def test_missing_pages(spark):
    chunks = spark.createDataFrame([("d", 1, 1, 2), ("d", 2, 4, 5), ("d", 0, 3, 3)], "document_id string, chunk_index int, page_start int, page_end int")
    documents = spark.createDataFrame([("d", 5)], "document_id string, page_count int")
    assert [r.page_num for r in C.missing_pages(chunks, documents).collect()] == [3]


def test_chunk_reads(spark, tmp_path):
    rows = [("c", "d", i, i, i, f"Text {i}") for i in range(5)]
    chunks = spark.createDataFrame(rows, CHUNK)
    assert [r.chunk_index for r in C.chunk_range(chunks, "d").collect()] == [1, 2, 3, 4]
    assert [r.chunk_index for r in C.chunk_range(chunks, "d", chunk_indexes=[0, 2]).collect()] == [0, 2]
    documents = spark.createDataFrame([("x", "T")], "document_id string, title string")
    hits = C.search_chunks(chunks, documents, "TEXT 3").collect()
    assert [(r.chunk_index, r.document_title) for r in hits] == [(3, "(unknown)")]
    assert C.search_chunks(chunks, documents, "T").count() == 0

    from filingmill.sources import tables

    path = str(tmp_path / "chunks")
    other = spark.createDataFrame([("c", f"o{i}", 1, 1, 1, "z") for i in range(300)], CHUNK)
    tables.write_chunks(chunks.unionByName(other), path)
    tables.write_chunks(chunks.where("chunk_index < 2"), path)
    back = spark.read.parquet(path)
    assert back.where("document_id = 'd'").count() == 2
    assert back.where("document_id <> 'd'").count() == 300
