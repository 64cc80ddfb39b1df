"""A page's block elements and text blocks as a tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Element names of HTML by role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark "
    "nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text, dropped with all they hold.
UNSEEN = frozenset(
    "script style title template noscript svg math iframe object canvas audio video map "
    "textarea select button datalist".split()
)
RAW = frozenset("script style title textarea iframe noscript".split())
#: Blocks that end an open svg or math, and other unseen elements without an end.
BLOCKS = frozenset(
    "address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of svg and math that hold blocks.
HOLDS_BLOCKS = frozenset("foreignobject desc annotation-xml".split())
#: Unseen elements that never stand in their like.
ALONE = frozenset("button select".split())
#: A start of the key closes an open one of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
#: Elements inside which those above are looked for.
SCOPE = frozenset("ul ol dl table body".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # A quote opens a string only behind an equals sign.
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>"
    # A start of a tag that has no end.
    r"|(<)(?=/?[a-zA-Z])",
    re.S,
)
_PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


@dataclass
class Page:
    """Nodes in page order: a parent always stands before its children.

    ``text`` is null for elements. ``links`` counts the characters of a text
    block that stand inside links.
    """

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, marks: str, text: str | None, links: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def marks_of(attributes: str) -> str:
    """Class, id, role and hiding of an element, lowered."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    out = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            out.append("hidden-element")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden-element")
        elif name != "aria-hidden":
            out.append(value)
    return " ".join(out)


def parse(source: str) -> Page:
    """The tree of a page, whatever its markup; text blocks are leaves.

    The tags of head mean nothing here: what it may hold is unseen anyway, and
    anything else starts the body. An unseen element that is still open where
    an element around it or the page ends, has no end: it holds what stands
    before its first block, or nothing if the page ends before any block.
    Script and style without an end hold the rest of the page. Behind a tag
    that has no end, quotes mean nothing and tags end at the next ``>``.

    Each step looks at open elements by name, and an element without an end is
    found once, so the time grows with the page whatever it holds; only svg and
    math without an end that hold blocks in each other are read again for each.
    """
    page = Page()
    page.add(-1, "html", "", None, 0)
    stack: list[tuple[str, int]] = [("html", 0)]
    depths: dict[str, list[int]] = {}
    buffer: list[str] = []
    state = {"links": 0, "inside": 0}

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                name, node = stack[-1]
                page.add(node, name, "", text, min(state["links"], len(text)))
            buffer.clear()
        state["links"] = 0

    def take(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if state["inside"]:
                state["links"] += len(text.strip())

    def push(name: str, marks: str) -> None:
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, page.add(stack[-1][1], name, marks, None, 0)))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()

    def innermost(names: set[str] | frozenset[str]) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        depth = innermost(names)
        if depth and depth >= innermost(scope):
            flush()
            pop_to(depth)
            state["inside"] = 0

    at, skip = 0, None
    token, until = _TOKEN, len(source)
    #: Elements inside the unseen one: names, places behind their start tags, number of each name.
    inner: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    opened, block = 0, None
    endless: set[str] = set()
    #: Where unseen elements end that have no end tag, and the element whose end that is.
    known: dict[int, tuple[int, str]] = {}
    past = len(source) + 1
    last_block = -1

    def leave(place: int | None = None, outer: str = "html") -> None:
        """Forget the elements inside; those still open end at ``place``, if it is given."""
        for name, start in inner if place is not None else ():
            if name in UNSEEN and name not in ALONE:
                known[start] = place, outer
        inner.clear()
        held.clear()

    def after_raw(name: str, at: int) -> int:
        """Where the text of a raw element ends, behind its end tag."""
        if name not in endless:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if end is not None:
                return end.end()
            endless.add(name)
        return len(source) if name in ("script", "style") else at

    while True:
        found = token.search(source, at, until)
        if found is not None and token is _TOKEN and found[4]:
            token, until = _PLAIN, source.rfind(">") + 1
            until = max(until, found.start())
            continue
        if found is None:
            if skip is None:
                take(source[at:].partition("<!")[0])
                break
            leave(past)
            at, skip = opened if block is None else block, None
            continue
        if skip is None:
            take(source[at:found.start()])
        elif opened in known and found.start() >= known[opened][0]:
            # Known from an earlier reading to end here.
            leave()
            at, skip = found.start(), None
            continue
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, ends = name.lower(), bool(found[1])
        alone = found[3].endswith("/")
        if skip is not None:
            if ends and held[name]:
                while True:
                    last, start = inner.pop()
                    held[last] -= 1
                    if last == name:
                        break
                    if last in UNSEEN and last not in ALONE and name not in INLINE:
                        known[start] = found.start(), name
            elif ends and name == skip:
                skip = None
                leave()
            elif ends and (name in ("body", "html") or depths.get(name)):
                if block is None and name in ("body", "html"):
                    block = opened
                leave(past if name in ("body", "html") else found.start(), name)
                at, skip = found.start() if block is None else block, None
            elif ends:
                continue
            elif name in RAW and not alone:
                at = after_raw(name, at)
            elif name == skip and name in ALONE:
                # The one before has no end.
                leave()
                at, skip = found.start() if block is None else block, None
            elif name in BLOCKS and skip in ("svg", "math") and not any(held[h] for h in HOLDS_BLOCKS):
                leave()
                at, skip = found.start(), None
            elif name not in VOID and name not in ("html", "head", "body"):
                if name in BLOCKS:
                    last_block = max(last_block, found.start())
                    if block is None:
                        block = found.start()
                    if skip not in ("svg", "math") and opened in known:
                        leave()
                        at, skip = block, None
                        continue
                if not alone:
                    inner.append((name, at))
                    held[name] += 1
            continue
        if name == "head":
            flush()
            continue
        if name in UNSEEN:
            if ends or alone and name not in RAW:
                continue
            if name in RAW:
                at = after_raw(name, at)
            else:
                place, outer = known.get(at, (0, ""))
                if place != past and not depths.get(outer) or name in ("svg", "math") and at <= last_block:
                    # That element is no longer open, or a block may end it: read anew.
                    known.pop(at, None)
                if place != past or at <= last_block:
                    skip, opened, block = name, at, None
            if name not in ("script", "style", "template", "svg", "math", "noscript"):
                flush()
            continue
        if name in INLINE:
            if name == "a":
                state["inside"] = 0 if ends else 1
            elif name in ("br", "img") and not ends:
                buffer.append(" ")
            continue
        if name in VOID:
            flush()
            continue
        if ends:
            if name in ("html", "body"):
                flush()
            else:
                close({name}, frozenset())
            continue
        if name in ("html", "body"):
            flush()
            if name == "body" and len(stack) == 1:
                push("body", marks_of(found[3]))
            continue
        close({"p"}, SCOPE | {"td", "th", "li"})
        if name in CLOSES:
            close(CLOSES[name], SCOPE)
        flush()
        state["inside"] = 0
        push(name, marks_of(found[3]))
        if alone:
            pop_to(len(stack) - 1)
    flush()
    return page
