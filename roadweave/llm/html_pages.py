"""Labelled training pages, made by rule: blocks of the main text have label 1, all others 0."""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba be bi da de di fo ga ha he in ka ko la le li ma mo na ne no or pa pe ra re ri sa se so ta te ti to un va ve wo".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.parts, self.labels = rng, [], []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return html.escape(" ".join(out).capitalize() + r.choice([".", ".", ".", "", " & more.", "?", " %%% ***"]))

    def open(self, markup: str) -> None:
        self.parts.append(markup)

    def block(self, markup: str, label: int) -> None:
        self.parts.append(markup)
        self.labels.append(label)

    def links(self, n: int, label: int = 0) -> None:
        for _ in range(n):
            w = self.words(1, 3)
            self.block(f'<li><a href="/{w[:4]}">{w}</a></li>', label)


def _noise(p: _Page) -> None:
    """One part that is not main text."""
    r = p.rng
    kind = r.randrange(10)
    if kind == 0:
        tag = r.choice(["<nav>|</nav>", '<div class="menu">|</div>', '<div id="nav">|</div>', '<div class="breadcrumbs">|</div>'])
        a, b = tag.split("|")
        p.open(a + "<ul>")
        p.links(r.randint(2, 9))
        p.open("</ul>" + b)
    elif kind == 1:
        a = r.choice(['<div class="ad">', '<div class="advert">', '<div class="ads banner">', '<ins class="sponsored">', '<div id="ad-7">'])
        p.block(f"{a}{p.words(3, 30)}</{a[1:4]}>", 0)
    elif kind == 2:
        a = r.choice(["aside", 'div class="sidebar"', 'div id="sidebar"'])
        p.open(f"<{a}>")
        p.block(f"<h3>{p.words(1, 4)}</h3>", 0)
        for _ in range(r.randint(1, 3)):
            p.block(f"<p>{p.words(3, 40)}</p>", 0)
        p.open(f"</{a.split()[0]}>")
    elif kind == 3:
        p.open("<form>")
        p.block(f"<label>{p.words(1, 4)}</label><input>", 0)
        if r.random() < 0.5:
            p.block(f"<p>{p.words(5, 30)}</p>", 0)
        p.block(f"<button>{p.words(1, 2)}</button>", 0)
        p.open("</form>")
    elif kind == 4:
        a = r.choice(["cookie-notice", "notice", "alert", "newsletter subscribe", "banner"])
        p.open(f'<div class="{a}">')
        for _ in range(r.randint(1, 2)):
            p.block(f"<p>{p.words(4, 40)}</p>", 0)
        p.open("</div>")
    elif kind in (5, 6):
        a = r.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"'])
        p.open(f"<{a}>")
        if r.random() < 0.6:
            p.block(f"<h3>{p.words(1, 3)}</h3>", 0)
        for _ in range(r.randint(1, 6)):
            b = r.choice(["div", "article", "li"])
            p.open(f'<{b} class="comment">')
            for _ in range(r.randint(1, 3)):
                p.block(f"<p>{p.words(2, 60)}</p>", 0)
            p.open(f"</{b}>")
        p.open(f"</{a.split()[0]}>")
    elif kind == 7:
        a = r.choice(["share", "related", "promo", "social", "tags", "widget"])
        p.open(f'<div class="{a}"><ul>')
        p.links(r.randint(2, 5))
        p.open("</ul></div>")
    elif kind == 8:
        p.open("<header>")
        p.block(f"<div>{p.words(1, 5)}</div>", 0)
        if r.random() < 0.5:
            p.block(f"<p>{p.words(3, 25)}</p>", 0)
        p.open("</header>")
    else:
        a = r.choice(["footer", 'div class="footer"', 'div id="footer"'])
        if r.random() < 0.5:
            p.block(f"<{a}>&copy; {p.words(2, 30)}</{a.split()[0]}>", 0)
        else:
            p.open(f"<{a}>")
            for _ in range(r.randint(1, 3)):
                p.block(f"<p>{p.words(3, 40)}</p>", 0)
            p.open(f"</{a.split()[0]}>")


def _article(p: _Page) -> None:
    r = p.rng
    a = r.choice(["article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post entry"', 'div class="article-body"', "article", "section"])
    p.open(f"<{a}>")
    p.block(f"<h1>{p.words(2, 12)}</h1>", 1)
    for _ in range(r.randint(1, 14)):
        x = r.random()
        if x < 0.62:
            p.block(f"<p>{p.words(1, 90)}</p>", 1)
        elif x < 0.70:
            p.block(f"<p><b>{p.words(1, 40)}<br>", 1)
        elif x < 0.76:
            p.block(f"<h2>{p.words(1, 6)}</h2>", 1)
        elif x < 0.80:
            p.block(f"<blockquote>{p.words(4, 40)}</blockquote>", 1)
        elif x < 0.84:
            p.open("<ul>")
            for _ in range(r.randint(1, 4)):
                p.block(f"<li>{p.words(1, 20)}</li>", 1)
            p.open("</ul>")
        elif x < 0.88:
            p.block(f'<p>{p.words(5, 40)} <a href="/x">{p.words(1, 4)}</a> {p.words(3, 20)}</p>', 1)
        elif x < 0.91:
            p.block(f"<pre>{p.words(2, 20)}</pre>", 1)
        elif x < 0.94:
            p.open("<table><tr>")
            for _ in range(r.randint(1, 4)):
                p.block(f"<td>{p.words(1, 6)}</td>", 1)
            p.open("</tr></table>")
        else:
            _noise(p)
    p.open(f"</{a.split()[0]}>")


def _bare_page(p: _Page) -> None:
    """A page whose elements tell nothing by their kinds or names: what is main text shows in its words, links and neighbours alone."""
    r = p.rng
    name = lambda: r.choice(["", "", f' class="{"".join(r.choices(_SYLLABLES, k=2))}{r.randint(1, 99)}"'])

    def linked_line() -> None:
        tag = r.choice(["div", "p", "td", "center"])
        a, b = ("<table><tr><td>", "</td></tr></table>") if tag == "td" else (f"<{tag}{name()}>", f"</{tag}>")
        links = r.choice([" ", " | ", " &middot; "]).join(f'<a href="/{k}">{p.words(1, 3)}</a>' for k in range(r.randint(3, 9)))
        p.block(a + links + b, 0)

    def linked_list() -> None:
        p.open(f"<ul{name()}>")
        p.links(r.randint(3, 9))
        p.open("</ul>")

    def scrap() -> None:
        p.block(r.choice([f"<div{name()}>&copy; {p.words(1, 5)}</div>", f"<div{name()}>{p.words(1, 4).rstrip('.')}</div>", f"<footer><p>{p.words(2, 12)}</p></footer>", f'<div><a href="/">{p.words(1, 2)}</a> <a href="/b">{p.words(1, 2)}</a></div>']), 0)

    depth = r.randint(0, 3)
    p.open("".join(f"<div{name()}>" for _ in range(depth)))
    for _ in range(r.randint(0, 2)):
        r.choice([linked_line, linked_list])()
    if r.random() < 0.9:
        inner = r.randint(0, 3)
        p.open("".join(f"<div{name()}>" for _ in range(inner)))
        if r.random() < 0.9:
            p.block(f"<h1{name()}>{p.words(2, 10)}</h1>", 1)
        for _ in range(r.randint(2, 10)):
            kind = r.random()
            if kind < 0.4:
                p.block(f"<p{name()}>{p.words(8, 80)}</p>", 1)
            elif kind < 0.6:
                p.block(f"<div{name()}>{p.words(12, 80)}</div>", 1)
            elif kind < 0.8:
                p.block(f"<div{name()}><div>{'<br><br>'.join(p.words(10, 60) for _ in range(r.randint(2, 4)))}</div></div>", 1)
            elif kind < 0.9:
                p.block(f"<h2>{p.words(1, 6)}</h2>", 1)
            else:
                p.block(f'<p>{p.words(8, 40)} <a href="/x">{p.words(1, 3)}</a> {p.words(5, 20)}</p>', 1)
        p.open("</div>" * inner)
    for _ in range(r.randint(0, 3)):
        r.choice([linked_line, linked_list, scrap, scrap])()
    p.open("</div>" * depth)


def training_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(html, labels of its text blocks in order) for `count` pages of mixed layouts and half as many bare ones; the same for the same seed."""
    out = []
    for k in range(count):
        p = _Page(random.Random(f"{seed}:{k}"))
        p.open('<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
        for _ in range(p.rng.randint(0, 3)):
            _noise(p)
        if p.rng.random() < 0.95:
            _article(p)
        for _ in range(p.rng.randint(0, 3)):
            _noise(p)
        p.open(p.rng.choice(["</body></html>", ""]))
        out.append(("".join(p.parts), p.labels))
    for k in range(count // 2):
        p = _Page(random.Random(f"{seed}:bare:{k}"))
        p.open("<html><head><title>x</title></head><body>")
        _bare_page(p)
        out.append(("".join(p.parts), p.labels))
    return out


