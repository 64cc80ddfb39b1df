"""Main text of pages by a tree-structured graphical model over the DOM.

Each block element and text block is a binary variable: content or not. Unary
potentials look at its tag, the words of its class and id, text length, link
share and end marks; a potential on each parent-child edge says how labels
agree, by kind of child. Sum-product messages go from the leaves to the root
and back, level by level for all pages of a batch, and give exact marginals on
the tree. A text block with a marginal of 0.5 or more is main text.

Potentials are fitted by maximum likelihood on labelled pages, with the same
messages for the expected counts. ``examples.labelled_pages`` writes a fixed
set of pages of many layouts with labels; other labelled pages can be given.

Defined results: a null or empty page, or one without text, has an empty text.
Markup that is broken is read as far as it goes. Repeated pages are each
extracted. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingmill.llm import examples
from filingmill.llm.common import batches_of, slices
from filingmill.llm.htmltree import Page, parse

CUT = 0.5
KINDS = 3
#: Words of class and id by what they tell: fixed values.
WORDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar skip",
    "head": "header masthead banner logo site-header branding hero",
    "foot": "footer foot copyright legal colophon site-footer",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp outbrain taboola",
    "note": "cookie cookies consent notice notification alert gdpr banner popup modal overlay toast paywall disclaimer",
    "talk": "comment comments reply replies discussion disqus respond thread reader readers",
    "form": "form search login signup signin subscribe subscription newsletter register contact",
    "share": "share sharing social follow like related recommended recommendations more trending popular tags",
    "main": "article content post entry story main body text page-content maincontent entry-content story-body",
    "hidden": "hidden-element sr-only visually-hidden hidden",
}
_GROUP: dict[str, list[str]] = {}
for _group, _words in WORDS.items():
    for _word in _words.split():
        _GROUP.setdefault(_word, []).append(_group)
_SPLIT = re.compile(r"[^a-z]+")
TAGS = (
    "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table tr td th blockquote pre figure figcaption address fieldset label details summary hr center"
).split()


def _names() -> dict[str, int]:
    """Feature numbers; a text block has its own features by its element."""
    names = ["bias:element", "bias:text"]
    names += [f"tag:{t}" for t in [*TAGS, "other"]] + [f"in:{t}" for t in [*TAGS, "other"]]
    names += [f"word:{g}" for g in WORDS]
    for kind in ("element", "text"):
        names += [f"{kind}:size{i}" for i in range(9)] + [f"{kind}:links{i}" for i in range(4)]
    names += ["text:ends", "text:commas", "text:capitals"]
    return {n: i for i, n in enumerate(names)}


_FEATURE = _names()
_KNOWN = frozenset(TAGS)


@functools.lru_cache(maxsize=20_000)
def groups_of(marks: str) -> tuple[int, ...]:
    found = {g for w in marks.split() for g in _GROUP.get(w, ())}
    found |= {g for w in _SPLIT.split(marks) for g in _GROUP.get(w, ())}
    return tuple(sorted(_FEATURE[f"word:{g}"] for g in found))


def _links(part: float) -> int:
    return 0 if part == 0 else 1 if part < 0.34 else 2 if part < 0.8 else 3


class Forest:
    """The trees of many pages with features, as arrays."""

    def __init__(self, pages: list[Page]):
        parents, kinds, ids, starts, base = [], [], [], [], 0
        self.begin = [0]
        for page in pages:
            n = len(page.parent)
            size, links = [0] * n, [0] * n
            for i in range(n - 1, -1, -1):
                if page.text[i] is not None:
                    size[i], links[i] = len(page.text[i]), page.links[i]
                up = page.parent[i]
                if up >= 0:
                    size[up] += size[i]
                    links[up] += links[i]
            for i in range(n):
                starts.append(len(ids))
                text, tag = page.text[i], page.tag[i] if page.tag[i] in _KNOWN else "other"
                kind = "element" if text is None else "text"
                ids.append(_FEATURE[f"bias:{kind}"])
                ids.append(_FEATURE[f"{kind}:size{min(8, size[i].bit_length() // 2 + (size[i] > 0))}"])
                ids.append(_FEATURE[f"{kind}:links{_links(links[i] / size[i] if size[i] else 0)}"])
                if text is None:
                    ids.append(_FEATURE[f"tag:{tag}"])
                    words = groups_of(page.marks[i]) if page.marks[i] else ()
                    ids.extend(words)
                    kinds.append(1 if words else 0)
                else:
                    ids.append(_FEATURE[f"in:{tag}"])
                    if text[-1] in ".!?…\"”»:;":
                        ids.append(_FEATURE["text:ends"])
                    if ", " in text:
                        ids.append(_FEATURE["text:commas"])
                    if text.isupper():
                        ids.append(_FEATURE["text:capitals"])
                    kinds.append(2)
                parents.append(page.parent[i] + base if page.parent[i] >= 0 else -1)
            base += n
            self.begin.append(base)
        self.parent = np.array(parents, dtype=np.int64)
        self.kind = np.array(kinds, dtype=np.int64)
        self.ids, self.starts = np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)
        depth = np.zeros(base, dtype=np.int64)
        for i, up in enumerate(parents):
            if up >= 0:
                depth[i] = depth[up] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1))
        self.levels = np.split(order, cuts)[1:]


class Model:
    """Unary weights of content, and edge potentials [kind, parent, child]."""

    def __init__(self) -> None:
        self.unary = np.zeros(len(_FEATURE))
        self.edge = np.zeros((KINDS, 2, 2))

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent label, child label) of its edge."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.add.reduceat(self.unary[forest.ids], forest.starts) if n else 0
        below = own.copy()
        up = np.zeros((n, 2))
        for level in reversed(forest.levels):
            joint = self.edge[forest.kind[level]] + below[level][:, None, :]
            up[level] = np.logaddexp(joint[..., 0], joint[..., 1])
            np.add.at(below, forest.parent[level], up[level])
        down = np.zeros((n, 2))
        pairs = np.zeros((n, 2, 2))
        for level in forest.levels:
            rest = (below + down)[forest.parent[level]] - up[level]
            joint = self.edge[forest.kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            full = joint + below[level][:, None, :]
            full = np.exp(full - full.max(axis=(1, 2), keepdims=True))
            pairs[level] = full / full.sum(axis=(1, 2), keepdims=True)
        belief = below + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pairs


def trained(pages: list[tuple[Page, list[int]]], rounds: int = 200, ridge: float = 0.003) -> Model:
    """Fit the potentials to pages with a label for each node."""
    forest, model = Forest([p for p, _ in pages]), Model()
    label = np.array([x for _, labels in pages for x in labels])
    counts = np.diff(np.append(forest.starts, len(forest.ids)))
    node = np.repeat(np.arange(len(label)), counts)
    has_up = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(model.edge)
    np.add.at(seen, (forest.kind[has_up], label[forest.parent[has_up]], label[has_up]), 1)
    speed_u, speed_e = np.zeros_like(model.unary), np.zeros_like(model.edge)
    square_u, square_e = np.zeros_like(model.unary), np.zeros_like(model.edge)
    for turn in range(1, rounds + 1):
        p, pairs = model.marginals(forest)
        gap = np.bincount(forest.ids, (label - p)[node], len(model.unary)) / len(pages) - ridge * model.unary
        held = np.zeros_like(model.edge)
        np.add.at(held, forest.kind[has_up], pairs[has_up])
        edge_gap = (seen - held) / len(pages) - ridge * model.edge
        for w, g, v, s in ((model.unary, gap, speed_u, square_u), (model.edge, edge_gap, speed_e, square_e)):
            v += 0.1 * (g - v)
            s += 0.01 * (g * g - s)
            w += 0.1 * (v / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.99 ** turn)) + 1e-8)
    return model


def labelled(sources: list[tuple[str, str]]) -> list[tuple[Page, list[int]]]:
    """Trees with labels from (html, marker) pages.

    Text blocks that hold the marker are content; it is taken out of the text.
    An element is content if it holds any.
    """
    out = []
    for source, marker in sources:
        page = parse(source)
        label = [0] * len(page.parent)
        for i in range(len(label) - 1, -1, -1):
            text = page.text[i]
            if text is not None:
                label[i] = int(marker in text)
                page.text[i] = " ".join(text.replace(marker, "").split()) or "-"
            if label[i] and page.parent[i] >= 0:
                label[page.parent[i]] = 1
        out.append((page, label))
    return out


@functools.cache
def default_model() -> Model:
    return trained(labelled(examples.labelled_pages()))


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page: its content blocks joined by empty lines."""
    pages = [parse(s) for s in sources]
    forest = Forest(pages)
    p, _ = model.marginals(forest)
    return [
        "\n\n".join(
            t for t, score in zip(page.text, p[a:b]) if t is not None and score >= CUT
        )
        for page, a, b in zip(pages, forest.begin[:-1], forest.begin[1:])
    ]


def main_text(
    pages: DataFrame, model: Model | None = None,
    key: str = "page_id", url: str = "url", source: str = "html",
) -> DataFrame:
    """Key, url and main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            for part in slices(sources):
                texts = main_texts(sources[part.start:part.stop], own)
                rows = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string())], [key, url, "text"]
                )

    batches_of(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(source).cast("string"))
    return rows.mapInArrow(run, f"{key} long, {url} string, text string")
