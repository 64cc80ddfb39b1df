"""Labelled pages for training: many layouts, written from a seed.

Each page is made of an article and of menus, headers, footers, sidebars,
notices, adverts, forms and reader comments in varying markup. Content blocks
carry ``MARKER``, so a reader of the page can label its text blocks. Sentences
are made of syllables and say nothing in any language.
"""

from __future__ import annotations

import random

MARKER = "⁂"
PAGES = 700
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu än éti ción sch ung the of and".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(1, 14).capitalize()
        if self.rng.random() < 0.3:
            text += ", " + self.words(1, 6)
        return text + self.rng.choice("....!?")

    def prose(self, low: int = 1, high: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        return text.replace(" the", " &amp; the", 1) if self.rng.random() < 0.1 else text

    def pick(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(low, high))]

    def box(self, tags: str, names: str, inside: str) -> str:
        """An element with a telling class or id, plain or with more words."""
        tag, name = self.rng.choice(tags.split()), self.rng.choice(names.split())
        more = self.pick("", "", f" {self.word()}", f" {name}-{self.word()}", " clearfix")
        return f'<{tag} {self.pick("class", "class", "id")}="{name}{more}">{inside}</{tag}>'

    def wrapped(self, text: str) -> str:
        return self.pick(text, f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{text}</p><p>{self.prose(1, 2)}</p>")

    def menu(self) -> str:
        items = self.links(3, 9)
        inner = self.pick(
            "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>",
            "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>",
            " | ".join(items), " ".join(items),
        )
        return self.pick(f"<nav>{inner}</nav>", self.box("div ul nav", "nav menu navbar main-menu breadcrumbs", inner))

    def header(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.sentence()}</p>")
        inner += self.menu() if self.rng.random() < 0.5 else ""
        return self.pick(f"<header>{inner}</header>", self.box("div header", "header masthead site-header topbar", inner))

    def advert(self) -> str:
        return self.box("div aside section div", "ad ads advert advertisement sponsored promo", self.wrapped(self.prose(1, 3)))

    def notice(self) -> str:
        inner = self.wrapped(self.prose(1, 2)) + self.pick("", "<button>OK</button>")
        return self.box("div section aside", "cookie cookie-banner notice consent alert newsletter popup", inner)

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.pick(
            self.wrapped(self.prose(1, 3)),
            "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(3, 7)) + "</ul>",
        )
        return self.pick(f"<aside>{inner}</aside>", self.box("div aside", "sidebar widget related rail", inner))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q>" + self.pick("", f"<p>{self.prose(1, 2)}</p>")
        return f'<form action="/s">{inner}<button>{self.word()}</button></form>'

    def comments(self) -> str:
        entries = "".join(
            self.pick(
                f'<div class="comment"><b>{self.word()}</b><p>{self.prose(1, 4)}</p></div>',
                f"<li><p>{self.prose(1, 3)}</p></li>",
                f'<div class="{self.pick("comment-body", "reply")}">{self.prose(1, 3)}</div>',
            )
            for _ in range(self.rng.randint(1, 5))
        )
        inner = self.pick("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 2)}</h3>") + entries
        return self.box("section div ol", "comments comment-list discussion", inner)

    def footer(self) -> str:
        inner = self.pick(
            f"&copy; {self.word()} &middot; {self.prose(1, 2)}", f"<p>&copy; 2020 {self.words(1, 5)}</p>",
            f"<p>{self.prose(1, 3)}</p>" + " ".join(self.links(2, 5)),
        )
        return self.pick(f"<footer>{inner}</footer>", self.box("div footer", "footer site-footer copyright", inner))

    def hidden(self) -> str:
        text = self.prose(1, 3)
        return self.pick(f"<div hidden><p>{text}</p></div>", f'<div style="display:none">{text}</div>')

    def block(self) -> str:
        """One content block or list of them."""
        m, text = MARKER, self.prose()
        return self.pick(
            f"<p>{m}{text}</p>", f"<p>{m}{text}</p>", f"<p>{m}{text}</p>", f"<p>{m}{text}",
            f"<p>{m}{self.sentence()}</p>", f"<p><b>{m}{self.sentence()}<br><p>{m}{text}</p>",
            f"<p>{m}{text} {self.links(1, 1)[0]} {self.sentence()}</p>",
            f"<h2>{m}{self.words(1, 6)}</h2>", f"<h3>{m}{self.words(1, 4)}</h3>",
            f"<blockquote>{m}{text}</blockquote>", f"<blockquote><p>{m}{text}</p></blockquote>",
            "<ul>" + "".join(f"<li>{m}{self.words(1, 9)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>",
            "<ol>" + "".join(f"<li>{m}{self.sentence()}" for _ in range(self.rng.randint(1, 4))) + "</ol>",
            f"<table><tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr></table>",
            f"<pre>{m}{self.words(2, 9)}</pre>", f"<div>{m}{text}</div>",
            f"<section><h2>{m}{self.words(1, 5)}</h2><p>{m}{text}</p></section>",
        )

    def short(self) -> str:
        """A note of a few short blocks of one kind, mostly without a heading."""
        m, count = MARKER, self.rng.randint(1, 4)
        kind = self.pick("p", "p", "p", "li", "div", "pre")
        inner = "".join(
            f"<{kind}>{m}{self.pick(self.words(4, 25), self.sentence(), self.prose(1, 3))}</{kind}>" for _ in range(count)
        )
        if kind == "li":
            inner = f"<ul>{inner}</ul>"
        if self.rng.random() < 0.2:
            inner = f"<h2>{m}{self.words(1, 5)}</h2>" + inner
        return self.pick(
            f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            self.box("div section article", "content post entry-content story article-body main", inner),
            f"<div>{inner}</div>", inner,
        )

    def article(self) -> str:
        parts = [self.block() for _ in range(self.rng.choice((1, 1, 2, 2, 3, 5, 8, 12)))]
        for extra in (self.advert, self.sidebar, self.form, self.notice, self.hidden):
            if self.rng.random() < 0.18:
                parts.insert(self.rng.randint(0, len(parts)), extra())
        if self.rng.random() < 0.15:
            parts.append(self.comments())
        inner = self.pick("", f"<h1>{MARKER}{self.words(1, 9)}</h1>", f"<h1>{MARKER}{self.sentence()}</h1>") + "".join(parts)
        return self.pick(
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>",
            f"<main><article>{inner}</article></main>", f"<div><article>{inner}</article></div>",
            self.box("div section article", "content post entry-content story article-body main", inner),
            f"<div>{inner}</div>", inner,
        )

    def page(self) -> str:
        before = [f for f in (self.header, self.menu, self.advert, self.notice, self.form) if self.rng.random() < 0.5]
        after = [f for f in (self.sidebar, self.comments, self.form, self.advert, self.notice) if self.rng.random() < 0.4]
        bare = self.rng.random() < 0.35
        if bare:
            before, after = before[:self.rng.randint(0, 1)], after[:self.rng.randint(0, 1)]
        text = self.short() if self.rng.random() < 0.45 else self.article()
        parts = [f() for f in before] + [text] + [f() for f in after]
        if self.rng.random() < (0.3 if bare else 0.85):
            parts.append(self.footer())
        body = "".join(parts)
        body = self.pick(body, body, f'<div class="{self.pick("page", "wrapper", "container")}">{body}</div>')
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(count: int = PAGES, seed: int = 5) -> list[tuple[str, str]]:
    """(html, marker) of each page."""
    writer = _Writer(random.Random(seed))
    return [(writer.page(), MARKER) for _ in range(count)]
