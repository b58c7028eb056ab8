"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import table
from roadweave.llm.html_pages import training_pages

# Elements that begin and end a block; all others are inline.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html ins label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template noscript head title svg math object iframe canvas audio video".split())
# What may stand in head; any other start tag, and text, end it.
HEADED = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
# Start tags of HTML that end svg and math, except in their elements that hold HTML.
ENDS_FOREIGN = BLOCK | frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
# Elements that hide nothing when they have no end tag of their own.
BORNE = frozenset("template noscript title object iframe canvas audio video".split())
# What an element of the key's kind closes when it is open above it.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Open elements of these kinds that a start tag of a block may close, and those that it does not look beyond.
CLOSED = frozenset("p tr td th li dt dd option".split())
BARRIER = UNSEEN | BLOCK - CLOSED
_NAME = re.compile(r"[a-z]+")


class Path:
    """An open element and those around it; sets of their tags and names are shared along the path, so that deep pages cost no more a block."""

    __slots__ = ("above", "in_link", "names", "own", "tag", "tag_set", "under")

    def __init__(self, tag: str, names: tuple[str, ...], above: Path | None) -> None:
        self.tag, self.above = tag, above
        block = tag in BLOCK
        self.own = tag if block else above.own if above else ""
        self.under = (above.own if block else above.under) if above else ""
        self.in_link = tag == "a" or bool(above and above.in_link)
        around = above.tag_set if above else frozenset()
        self.tag_set = around | {tag} if block and tag not in around else around
        known = above.names if above else frozenset()
        self.names = known if known.issuperset(names) else known | set(names)


@dataclass
class Block:
    text: str
    linked: int
    path: Path | None

    @property
    def tags(self) -> tuple[str, ...]:
        """The block elements around the text, from the outermost."""
        found, at = [], self.path
        while at:
            if at.tag in BLOCK:
                found.append(at.tag)
            at = at.above
        return tuple(reversed(found))


class _Blocks(HTMLParser):
    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        """shown: the places of start tags, counted over the unseen kinds, that hide nothing."""
        super().__init__(convert_charrefs=True)
        self.stack: list[Path] = []
        self.depths: dict[str, list[int]] = {}  # of the open elements of each kind in the stack
        self.barriers: list[int] = []
        self.shown, self.opened, self.ignored = shown, 0, False
        self.hidden: list[tuple[int, int]] = []  # depth in the stack and place of each open unseen element
        self.unclosed: dict[str, list[int]] = {}
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = 0

    def set_cdata_mode(self, *args, **options) -> None:
        if not self.ignored:
            super().set_cdata_mode(*args, **options)

    def depth(self, *tags: str) -> int:
        """The depth of the innermost open element of these kinds, -1 for none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def push(self, tag: str, names: tuple[str, ...] = ()) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append(Path(tag, names, self.stack[-1] if self.stack else None))

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The place after a comment; one without an end, of which the whole page is at hand, ends at the next sign that could end a tag."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    # All of a page is at hand, so markup without an end is ended by the page's: nothing is searched for again and again.

    def parse_html_declaration(self, i: int) -> int:
        """The place after what begins with <! and is no comment: a doctype, or a bogus comment up to the next >."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else -1
        return end if end > i else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        """A start tag that the page cuts off is dropped with what stands in it."""
        return super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def cut(self, k: int, own: bool = False, noted: bool = True) -> None:
        """Ends the elements from depth k on; own: by the end tag of the one at k; noted: those without one are kept in mind."""
        while self.hidden and self.hidden[-1][0] >= k:
            depth, place = self.hidden.pop()
            if noted and not (own and depth == k) and self.stack[depth].tag in BORNE:
                self.unclosed.setdefault(self.stack[depth].tag, []).append(place)
        for e in self.stack[k:]:
            self.depths[e.tag].pop()
        while self.barriers and self.barriers[-1] >= k:
            self.barriers.pop()
        del self.stack[k:]

    def end_foreign(self) -> None:
        while self.hidden:
            k = self.hidden[-1][0]
            if self.stack[k].tag not in ("svg", "math") or self.depth(*HOLDS_HTML) > k:
                break
            self.cut(k)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.stack[-1] if self.stack else None))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.ignored = False
        if tag == "body" and self.hidden:
            self.cut(self.hidden[0][0], noted=False)
        if tag in ENDS_FOREIGN:
            self.end_foreign()
        if tag not in HEADED and self.in_head():
            self.cut(self.hidden[-1][0])
        if tag in UNSEEN:
            self.ignored = self.opened in self.shown or (tag == "head" and len(self.stack) > len(self.depths.get("html", ())))
            if not self.ignored:
                self.hidden.append((len(self.stack), self.opened))
                self.push(tag)
            self.opened += 1
            return
        if tag in BLOCK:
            self.flush()
            k = self.depth("p", *CLOSES.get(tag, "").split())
            if k > (self.barriers[-1] if self.barriers else -1):
                self.cut(k)
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            names = tuple(n for key, value in attrs if key in ("class", "id", "role") and value for n in _NAME.findall(value.lower()))
            self.push(tag, names)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        k = self.depth(tag)
        if k >= 0:
            self.cut(k, own=True, noted=tag != "head")
        elif self.unclosed.get(tag):
            self.unclosed[tag].pop()

    def in_head(self) -> bool:
        return bool(self.hidden) and self.stack[self.hidden[-1][0]].tag == "head"

    def handle_data(self, data: str) -> None:
        if data.strip() and self.in_head():
            self.cut(self.hidden[-1][0])
        if not self.hidden:
            self.text.append(data)
            if self.stack and self.stack[-1].in_link:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """The blocks with text of a whole page, in page order; unclosed and crossing elements are borne."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    p.cut(0)
    shown = frozenset(place for places in p.unclosed.values() for place in places)
    if shown:
        p = _Blocks(shown)
        p.feed(html or "")
        p.close()
        p.flush()
    return p.blocks


OUTSIDE = Path("", (), None)


def features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    path = b.path or OUTSIDE
    out = ["bias", f"own={path.own}"]
    out += [f"in={t}" for t in path.tag_set] + [f"name={n}" for n in path.names]
    out.append(f"words={0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 30 else 4}")
    out.append(f"links={0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.8 else 3}")
    out.append(f"stop={b.text[-1] in '.!?'}")
    out.append(f"mark={b.text[0] in '©®'}")
    if path.under:
        out.append(f"pair={path.under}>{path.own}")
    return out


@dataclass
class Field:
    """Weights of a two-label chain: by feature and label, and from label to label."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def fit(cls, pages: list[tuple[str, list[int]]], rounds: int = 120, penalty: float = 0.3, rate: float = 0.2) -> Field:
        """Maximum likelihood with an L2 penalty, by Adam over all pages at once. Pages without blocks are left out."""
        index: dict[str, int] = {}
        rows, cols, labels, firsts, n = [], [], [], [], 0
        for html, want in pages:
            found = blocks(html)
            if len(found) != len(want):
                raise ValueError("a training page has other blocks than labels")
            firsts += [True] + [False] * (len(found) - 1) if found else []
            for b, y in zip(found, want):
                for f in features(b):
                    rows.append(n)
                    cols.append(index.setdefault(f, len(index)))
                labels.append(y)
                n += 1
        rows, cols, y, first = np.array(rows), np.array(cols), np.array(labels), np.array(firsts)
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, n))
        steps = int(lengths.max())
        # Sums by block and by feature: every block has features, and blocks come in order.
        own, order = np.searchsorted(rows, np.arange(n)), np.argsort(cols, kind="stable")
        kinds, ranges = np.unique(cols[order], return_index=True)
        w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        truth_t = np.zeros((2, 2))
        np.add.at(truth_t, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
        for k in range(1, rounds + 1):
            e = np.add.reduceat(w[cols], own)
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            for s in range(steps):
                at = starts[lengths > s] + s
                a[at] = e[at] if s == 0 else e[at] + np.logaddexp.reduce(a[at - 1][:, :, None] + t, axis=1)
            for s in range(steps - 2, -1, -1):
                at = starts[lengths > s + 1] + s
                b[at] = np.logaddexp.reduce(t[None] + (e[at + 1] + b[at + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(a + b, axis=1)
            p = np.exp(a + b - z[:, None])
            p[np.arange(n), y] -= 1
            gw = penalty / len(starts) * w
            gw[kinds] += np.add.reduceat(p[rows[order]] / len(starts), ranges)
            at = np.flatnonzero(~first) - 1
            pair = np.exp(a[at][:, :, None] + t + (e[at + 1] + b[at + 1])[:, None, :] - z[at][:, None, None])
            gt = (pair.sum(0) - truth_t) / len(starts) + penalty / len(starts) * t
            for v, g, m, s in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        return cls(index, w, t)

    def decode(self, found: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi); ties go to label 0."""
        if not found:
            return []
        e = np.zeros((len(found), 2))
        for k, b in enumerate(found):
            e[k] = self.weights[[i for i in map(self.index.get, features(b)) if i is not None]].sum(0)
        best, back = e[0], np.zeros((len(found), 2), np.int8)
        for k in range(1, len(found)):
            score = best[:, None] + self.moves
            back[k] = score.argmax(0)
            best = score.max(0) + e[k]
        out = [int(best.argmax())]
        for k in range(len(found) - 1, 0, -1):
            out.append(int(back[k][out[-1]]))
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        found = blocks(html)
        return " ".join(b.text for b, y in zip(found, self.decode(found)) if y)


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field.fit(training_pages())


def extract(pages: DataFrame, field: Field, html: str = "html", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All columns of pages, with the main text and its code points; columns of these names are replaced. No shuffle; only the html goes to Python.

    Null, empty and text-free pages give an empty text. A page of any length is parsed whole, in time about proportional to it.
    """

    @F.arrow_udf("text string, length long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [field.main_text(h.as_py()) for h in column]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["text", "length"])

    out = pages.withColumn("__rw_found", found(F.col(html)))
    return out.select(*(c for c in pages.columns if c not in (text, length)), F.col("__rw_found.text").alias(text), F.col("__rw_found.length").alias(length))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page, as extract gives them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, trained()).select("page_id", "url", "text", "n_chars")
