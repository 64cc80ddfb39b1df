"""Tags whose attributes hold odd quotes."""

import re
import time

import pytest

from filingmill.llm import htmltext, htmltree


def texts(page):
    return [t for t in htmltree.parse(page).text if t is not None]


@pytest.mark.parametrize("page, want", [
    ("<div><p title=it's>Hello there world.</p><p>Second one's here.</p></div>", ["Hello there world.", "Second one's here."]),
    ('<p title=5">One.</p><p>Two.</p>', ["One.", "Two."]),
    ("<p title=\"a>b\" class='c>d'>One.</p>", ["One."]),
    ("<p title = \"a>b\">One.</p><p it's>Two.</p>", ["One.", "Two."]),
    ("<p title=''>One.</p><p title=\"\">Two.</p>", ["One.", "Two."]),
    ('<p title="open>One.</p><p>Two.</p>', ["One.", "Two."]),
    ("<p a=\"1\"b='2'>One.</p>", ["One."]),
])
def test_quotes_in_attributes(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", [
    "<p title='x" * 16_000, "<p title='x" * 16_000 + ">", "<div>" * 32_000, "<object>" * 20_000, "<svg>" * 20_000,
    "<div>" + "<object><p>x " * 16_000 + "</div>", "<object><p>" * 16_000 + "</p>" * 16_000, "<" + "x" * 200_000,
    "<dl><dt><ul>" + "<div>" * 16_000 + "<dd></dd>" * 16_000, "<button><div>" * 16_000, "<p a=" * 30_000 + '">"',
])
def test_time_grows_with_the_page(page):
    start = time.process_time()
    htmltree.parse(page)
    assert time.process_time() - start < 3


@pytest.mark.parametrize("page, want", [
    ("<object><p>One.</p>" * 60, ["One."] * 60),
    ("<svg> <object> One. </body> <video> <table>", ["One."]),
    ("<select> <div> <template> <p>One.</p> <select>", ["One."]),
    ("a <b c", ["a <b c"]),
    ("<p>One.</p><p title='x<p>Two.</p>", ["One.", "Two."]),
    ("<p>One.</p><p title='x", ["One.", "<p title='x"]),
])
def test_elements_without_an_end(page, want):
    assert texts(page) == want


W = "quiet river bends north past old mills and fields of barley while people walk home along dusty roads at dusk".split()


@pytest.mark.parametrize("page, blocks", [
    ("<article><p>{20}</p></article>", 1),
    ('<div class="content"><p>{20}.</p><p>{20}.</p><p>{20}.</p><p>{20}.</p></div>', 4),
    ("<main><p>{8}</p><p>{8}</p></main>", 2),
    ("<p>{12}.</p>", 1),
    ("<article><ul><li>{3}</li><li>{5}</li></ul></article>", 2),
    ("<html><body><h1>{2}</h1><p>{9}</p></body></html>", 2),
    ("<body><nav><a href=/>Home</a><a href=/a>About us</a></nav><article><p>{20}</p></article><footer>&copy; 2020 Some Name</footer>", 1),
])
def test_short_articles(page, blocks):
    source = re.sub(r"\{(\d+)\}", lambda m: " ".join(W[:int(m[1])]), page)
    found = htmltext.main_texts([source], htmltext.default_model())[0].split("\n\n")
    assert len(found) == blocks and all(t.split()[0] == "quiet" for t in found)
