"""Held-out accuracy of the trained models, and the pipeline by brute force."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import brute_components
from filingmill.llm import examples, htmltext, quality, toxicity
from filingmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "label", "parts", "part", "least"),
    [("op1_quality", "quality", 4, 2, 0.97), ("op8_toxicity", "toxic", 5, 0, 0.93)],
)
def test_held_out_accuracy(spark, name, label, parts, part, least):
    rows = QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= least * len(own)


ODD = [(1, None, 0), (2, "", 0), (3, "x" * 400_000, 0), (4, "Ünï " * 3, 0), (4, "Ünï " * 3, 0), (None, "a", 0), (7, "퟿🙂", 0)]
GOOD = ["Some plain words in a row, and more of them.", "Another day passes by the quiet river.", "They walked home."]
BAD = ["BUY!! NOW!! BUY!! NOW!!", "home | about | login | help", "x%%% y$$$ z###"]


def labelled(spark):
    docs = ODD + [(100 + i, (GOOD if i % 2 else BAD)[i % 3] + f" {'abcdef'[i % 6]}", 1) for i in range(60)]
    table = spark.createDataFrame([(i, t, s, 0.5) for i, t, s in docs], "doc_id long, text string, score int, _x double")
    labels = [(100 + i, i % 2, 1 - i % 2) for i in range(60)] + [(100, 1, 1), (None, 1, 1), (3, None, None), (999, 1, 0)]
    return table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_models_on_odd_rows(spark):
    docs, labels = labelled(spark)
    good = quality.quality_scores(docs, labels)
    assert good.columns == [*docs.columns, "_score"]
    scores = {r.doc_id: r._score for r in good.collect()}
    assert len(scores) == 66 and all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[100 + i] > 0.5) == (i % 2 == 1) for i in range(60)) >= 55
    bad = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert bad.keys() == scores.keys() and all(0 <= s <= 1 for s in bad.values())
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count()
    net = quality.trained([(t, int(i > 2)) for i, t in enumerate(BAD + GOOD)], epochs=2)
    assert quality.scored(docs.limit(0), net).collect() == []
    with pytest.raises(ValueError, match="both kinds"):
        quality.quality_scores(docs, labels.limit(0))


def test_quality_network_gradients():
    import numpy as np

    net, rows = quality.Network(1), ["hello there world " * 30, "A!! B!! C!!"]
    goal, weight = np.array([1, 0]), np.ones(2)
    for name in ("table", "echo", "bias", "out", "shift"):
        setattr(net, name, getattr(net, name).astype(float))
    net.bias += 0.01  # away from the kink that padding has at zero
    batch = quality.planes(rows)
    slope = net.gradients(batch, goal, weight)

    def loss():
        p = np.clip(net.scores(rows), 1e-12, 1 - 1e-12)
        return -np.mean(goal * np.log(p) + (1 - goal) * np.log(1 - p))

    for w, g in zip(net.weights(), slope):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_quality_of_a_text_alone_and_in_a_batch():
    net = quality.trained([(t, int(i > 2)) for i, t in enumerate(BAD + GOOD)], epochs=2)
    line = "Same words in a row, and so on. "
    rows = [line * 4, line * 4, line * 3, (line * 4)[:127], "", "!" * 256, line[:31], line * 40, *BAD, *GOOD, line * 4]
    alone = [net.scores([t])[0] for t in rows]
    assert net.scores(rows).tolist() == alone and net.scores(rows[::-1]).tolist() == alone[::-1]


def test_kernel_table_equals_sum_over_landmarks():
    units = ["idiot", "clown", "quiet", "idxiot"]
    machine = toxicity.Machine(["idiot", "clown"], ["quiet", "river"], 4)
    direct = {}
    for u in units:
        for k, n, w in toxicity.image(u):
            direct.setdefault(u, 0.0)
            direct[u] += w * machine.tables[k][n]
    got = toxicity.Units([" ".join(units)]).values(machine.tables)
    assert all(abs(a - direct[u]) < 1e-4 for a, u in zip(got, units))
    scores = machine.unit_scores(toxicity.Units(["i d i o t", "i.d.i.o.t", "idiot", "quiet"]))
    assert scores[0] == pytest.approx(scores[2]) and scores[1] == pytest.approx(scores[2]) and scores[2] > scores[3]


def test_html_marginals_are_exact():
    import itertools

    import numpy as np

    model = htmltext.default_model()
    page = htmltext.parse("<body><nav>Menu</nav><div><p>One, two three.<p>Four.</div></body>")
    forest = htmltext.Forest([page])
    p, _ = model.marginals(forest)
    own = np.add.reduceat(model.unary[forest.ids], forest.starts)
    total, held = 0.0, np.zeros(len(own))
    for x in itertools.product((0, 1), repeat=len(own)):
        score = sum(own[i] for i in range(len(x)) if x[i])
        score += sum(model.edge[forest.kind[i], x[u], x[i]] for i, u in enumerate(forest.parent) if u >= 0)
        total += np.exp(score)
        held += np.exp(score) * np.array(x)
    assert np.allclose(p, held / total)


def test_html_blocks_on_unseen_layouts():
    tests = htmltext.labelled(examples.labelled_pages(80, seed=77))
    forest = htmltext.Forest([p for p, _ in tests])
    p, _ = htmltext.default_model().marginals(forest)
    label = [x for _, own in tests for x in own]
    texts = [t is not None for page, _ in tests for t in page.text]
    right = [(a >= 0.5) == b for a, b, t in zip(p, label, texts) if t]
    assert sum(right) >= 0.97 * len(right)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-banner">We use cookies.</div>
<article><h1>Big &amp; bold&nbsp;title</h1><p>First   para <a href="x>y">with a link</a>,
and a caf&eacute; &#x2014; fine.<p>Second <b>one</b>.<!-- <p>gone --><div class="ad">Buy this now.</div>
<ul><li>Item one, with words.<li>Item two.</ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like this a lot, thanks.</p></div></section>
<form><label>Mail</label><input><p>Sign up.</p></form><aside class="sidebar"><p>Other things to read.</p></aside>
<footer>&copy; 2020 Site</footer></body></html>"""


def test_html_page_and_odd_rows(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p><b><i", 5), (None, "u", PAGE, 5),
            (6, "u", "<div>" * 3000 + "deep words here, at last." + "</div>" * 10, 5), (7, "u", "a < b & c &bogus; <3", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    want = ["Big & bold title", "First para with a link, and a café — fine.", "Second one.", "Item one, with words.", "Item two."]
    assert got[1].text == got[None].text == "\n\n".join(want)
    assert got[2].text == got[3].text == "" and got[2].url is None
    assert htmltext.main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>T</title><p>One.<p>Two.", "One. Two."),
    ("<head><meta charset=x><script>'<p>no'</script><template><p>no</p></template>Bare text<p>One.", "Bare text One."),
    ("<head><title>T</title></head><body><p>One.</p></body>", "One."),
    ("<div><button>Go</div><p>One.", "One."),
    ("<body><button>Go<p>One.</p><button>Off</button><p>Two.</p></body></html>", "One. Two."),
    ("<div><select><option>A<option>B</div><p>One.</p><select><option>C</select><p>Two.", "One. Two."),
    ("<body><svg><path d='x'><p>One.</p>", "One."),
    ("<svg><foreignObject><p>no</p></foreignObject><g/></svg><p>One.", "One."),
    ("<ul><li><object data=x>no<li>One.</ul><p>Two.", "One. Two."),
    ("<object><object>no</object><div>no</div></object><p>One.", "One."),
    ("<template><script>'</div>'</script><div>no</div></template><p>One.", "One."),
    ("<object>One.", "One."),
    ("<iframe src=x><p>One.", "One."),
])
def test_html_left_out_ends(source, want):
    assert " ".join(t for t in htmltext.parse(source).text if t is not None) == want


def test_html_many_left_out_ends():
    for tag in ("object", "button", "select", "canvas", "iframe", "svg"):
        texts = [t for t in htmltext.parse(f"<{tag}><p>Words.</p>" * 5000).text if t is not None]
        assert texts == ["Words."] * 5000


def test_html_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    model = htmltext.default_model()
    texts = htmltext.main_texts([p.html for p in pages], model)
    import html

    for page, text in zip(pages, texts):
        body = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        blocks = (re.sub("<[^>]+>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:h1|p)>", body))
        assert text == "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    good = corpus_pipeline.stored(corpus_pipeline.keep_good(spark, docs, SF), "t1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and kept < before
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.99 * sum(labels.values())
    single = corpus_pipeline.stored(corpus_pipeline.drop_copies(spark, good, SF), "t2")
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    apart = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, single, SF), "t3")
    small = [(r.doc_id, r.text) for r in single.where(F.length("text") < 1500).orderBy("doc_id").collect()]
    comps = {k: c for k, _, c in brute_components(small, 80)}
    left = {r.doc_id for r in apart.collect()}
    assert not any(k in left for k, c in comps.items() if k != c)
    clean = corpus_pipeline.stored(corpus_pipeline.drop_leaks(spark, apart, SF), "t4")
    items = [" " + " ".join(re.findall(r"[^\W_]+", r.text.lower())) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in apart.collect():
        text = " " + " ".join(re.findall(r"[^\W_]+", (r.text or "").lower())) + " "
        if any(i in text for i in items):
            left.discard(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == left
    out = corpus_pipeline.encode(spark, clean, SF).collect()
    assert {r.doc_id for r in out} == left and all(r.n_tokens == len(r.ids) for r in out)
