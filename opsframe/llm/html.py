"""Main text of web pages by the distribution of text over lines.

Markup is stripped first: comments, scripts, styles and elements that say by tag, role or class that they are
no article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). What is left becomes
lines, one a block, with blank lines where block tags stood. A line weighs its code points, or nothing if most
of them are links. Sums over windows of ``WINDOW`` lines rise at a *surge* and are zero from a *dive* on; the
lines between are a region. Without an ``article`` or ``main`` element the regions whose highest window
reaches ``SHARE`` of the page's highest are the text, with what stands between them in their own box and a
first-level heading right before. With one, blank lines inside it never make a dive, and its regions count alone.

Text of inline tags runs on, ``br`` is a space and two of them part blocks; white space becomes one space and
blocks are joined by a line break. An unwanted element leaves one line end. Unclosed tags end with their parent, an unclosed unwanted one also where an
article begins. Null and empty pages, and pages of markup only, give an empty text. Repeated rows each get
their text; equal windows need no order, since all that reach the share count. An empty table gives an empty
result. Existing columns ``text`` and ``n_chars`` are replaced, others are kept. Time and memory are linear in the page.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import whole

WINDOW, SHARE = 3, 0.3
#: Pages turned into Python strings at a time.
STEP = 128

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in "script style title textarea iframe xmp noembed noframes".split()}
IN_HEAD = frozenset("base link meta noscript script style template title html head".split())
#: Block tags; boxes hold other blocks, so their edges part regions sooner.
BOX = frozenset("html body main article section div table td th header footer nav aside form fieldset dialog menu".split())
BLOCK = BOX | frozenset(
    "address blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre summary tbody tfoot thead tr ul".split())
#: A start tag ends an open one of the same kind.
SAME = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}

UNWANTED_TAGS = frozenset(
    "head title xmp noembed noframes script style noscript template svg math iframe object canvas audio video nav footer aside form menu dialog select button textarea datalist".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
UNWANTED_WORDS = frozenset(
    "ad ads adbox adslot adunit adsbygoogle banner consent copyright disclaimer footer gdpr login masthead menu menus menubar submenu modal nav navi navbar "
    "navigation notice notices notification overlay pager pagination popup recommended recommendations related reply replies respond search share sharing "
    "signup social subscribe subscription toolbar topbar widget alert disqus legal".split())
UNWANTED_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "promo", "sidebar", "sponsor")
#: ``has-sidebar`` and the like tell of the layout, not of the element.
LAYOUT = frozenset("has with no without is show hide js".split())
#: Headings of articles are no page headers.
ARTICLE_WORDS = frozenset("article entry post story content".split())
NEVER = frozenset("html body main".split())


@dataclass
class Line:
    text: str
    weight: int
    blanks: int
    box: int
    article: int
    main: int
    title: bool


@dataclass
class _Element:
    tag: str
    box: int
    article: int
    main: int
    unwanted: bool
    weak: bool = False  # unwanted and never closed: ends where an article begins


def _named_unwanted(names: str, in_article: bool) -> bool:
    """Whether a class or id says that the element is no article."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in LAYOUT:
            continue
        for w in {words[0], words[-1]}:
            if w in UNWANTED_WORDS or w.startswith(UNWANTED_STARTS) or w == "header" and not in_article and words[0] not in ARTICLE_WORDS:
                return True
    return False


def unwanted(tag: str, attributes: str, in_article: bool, hints: bool) -> bool:
    if tag in UNWANTED_TAGS or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in NEVER:
        return False
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    return given.get("role", "").lower() in UNWANTED_ROLES or hints and _named_unwanted(f"{given.get('class', '')} {given.get('id', '')}", in_article)


@dataclass
class _Page:
    """Lines of a page, read from left to right with the stack of open elements."""

    hints: bool
    lines: list[Line] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("", 0, 0, 0, False)])
    open: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    edges: int = 0
    breaks: int = 0
    number: int = 0
    weak: int = 0
    title: bool = False

    def text(self, raw: str) -> None:
        if self.stack[-1].unwanted or not raw:
            return
        raw = markup.unescape(raw) if "&" in raw else raw
        if raw.strip():
            if self.breaks > 1:
                self.flush(2)
            self.breaks = 0
            self.linked += len(raw.strip()) * bool(self.open.get("a"))
        self.parts.append(raw)

    def flush(self, edges: int) -> None:
        """End the line at a block's edge, if there is one."""
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            weight = 0 if 2 * self.linked > len(text) else len(text)
            self.lines.append(Line(text, weight, max(0, self.edges - 1), top.box, top.article, top.main, self.title))
            self.edges = 0
        self.edges += edges
        self.parts, self.linked, self.breaks, self.title = [], 0, 0, False

    def drop(self) -> _Element:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        self.weak -= e.weak
        return e

    def close(self, tag: str) -> None:
        """Close the last open ``tag`` and what is open inside it."""
        while self.open.get(tag):
            if self.stack[-1].tag in BLOCK:
                self.flush(0 if self.stack[-1].unwanted else 2 if self.stack[-1].tag in BOX else 1)
            if self.drop().tag == tag:
                return

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag not in IN_HEAD:
            self.close("head")
        if tag in BLOCK:
            self.close("p")
            if tag in ("article", "main"):
                while self.weak:
                    self.drop()
        if tag in SAME and self.stack[-1].tag == tag:
            self.close(tag)
        top = self.stack[-1]
        bad = top.unwanted or unwanted(tag, attributes, bool(top.article or top.main), self.hints)
        if tag in BLOCK:  # an unwanted element leaves one edge, whatever it holds
            self.flush(0 if top.unwanted else 1 if bad or tag not in BOX else 2)
            self.title = tag == "h1"
        if not (closed or bad or tag in BLOCK):
            return  # an inline tag without an end, such as a forgotten link
        self.number += 1
        self.stack.append(_Element(
            tag, self.number if tag in BOX else top.box, top.article or self.number * (tag == "article"),
            top.main or self.number * (tag == "main" or 'role="main"' in attributes), bad, bad and not top.unwanted and not closed))
        self.weak += self.stack[-1].weak
        self.open[tag] = self.open.get(tag, 0) + 1


def tokens(html: str) -> list[tuple[str, str, str]]:
    """``(kind, text or tag, attributes)`` with kinds ``text``, ``start`` and ``end``; raw text, comments and declarations are left out."""
    out, at, size = [], 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None or m.start() > at:
            out.append(("text", html[at:m.start() if m else size], ""))
        if m is None:
            break
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag:
            continue
        out.append(("end" if m[1] or m[4] else "start", tag, m[3] or m[6] or ""))
        if tag in RAW and out[-1][0] == "start":
            end = RAW[tag].search(html, at)
            at = end.start() if end else size
    return out


def lines_of(html: str, hints: bool = True) -> list[Line]:
    """Text lines of a page without its unwanted elements."""
    page, found, waiting, closed = _Page(hints), tokens(html), {}, set()
    for k, (kind, tag, _) in enumerate(found):
        if kind == "start":
            waiting.setdefault(tag, []).append(k)
        elif kind == "end" and waiting.get(tag):
            closed.add(waiting[tag].pop())
    for k, (kind, tag, attributes) in enumerate(found):
        if kind == "text":
            page.text(tag)
        elif kind == "end":
            page.close(tag)
            if tag == "p":
                page.flush(0)
        elif tag == "br":
            page.breaks += 1
            page.text(" ")
        elif tag in VOID:
            if tag == "hr":
                page.flush(1)
        else:
            page.start(tag, attributes, k in closed)
    page.flush(0)
    return page.lines


def _articles(lines: list[Line]) -> set[int]:
    """Places of the lines of the page's article elements, if they hold a fair share of its text."""
    total = sum(x.weight for x in lines)
    for kind in ("article", "main"):
        held: dict[int, int] = {}
        for x in lines:
            number = getattr(x, kind)
            if number:
                held[number] = held.get(number, 0) + max(x.weight, 1)
        most = max(held.values(), default=0)
        if most and most >= SHARE * total:
            chosen = {k for k, v in held.items() if 2 * v >= most}
            return {i for i, x in enumerate(lines) if getattr(x, kind) in chosen}
    return set()


def regions(lines: list[Line], close: bool) -> list[tuple[int, int, int]]:
    """First line, last line and highest window of every stretch from a surge to a dive; ``close``: blank lines never part."""
    places, owner = [], []
    for i, x in enumerate(lines):
        for _ in range(min(x.blanks, 1 if close else WINDOW) if i else 0):
            places.append(0)
            owner.append(-1)
        places.append(x.weight)
        owner.append(i)
    found: list[list[int]] = []
    zeros = WINDOW
    for at, weight in enumerate(places):
        if not weight:
            zeros += owner[at] >= 0 or not close
            continue
        high = sum(places[at:at + WINDOW])
        if zeros >= WINDOW:
            found.append([owner[at], owner[at], high])
        found[-1][1:] = [owner[at], max(found[-1][2], high)]
        zeros = 0
    return [(a, b, h) for a, b, h in found]


def main_text(html: str) -> str:
    """The article's blocks, joined by line breaks."""
    lines = lines_of(html) or lines_of(html, hints=False)
    inside = _articles(lines)
    if inside:
        own = [lines[i] for i in sorted(inside)]
        found = regions(own, close=True)
        spans = [(a, b) for a, b, _ in found]
        if spans:  # one or two links at an end are part of the article, a list of them is not
            first, last = spans[0][0], spans[-1][1]
            spans[0] = (0 if first < WINDOW else first, spans[0][1])
            spans[-1] = (spans[-1][0], len(own) - 1 if len(own) - 1 - last < WINDOW else last)
        else:
            spans = [(0, len(own) - 1)]
        lines = own
    else:
        found = regions(lines, close=False)
        least = SHARE * max((h for _, _, h in found), default=0)
        spans = [(a, b) for a, b, h in found if h >= least]
        if spans:
            boxes = {x.box for a, b in spans for x in lines[a:b + 1]}
            between = [(a, b) for a, b, h in found if h < least and spans[0][0] < a < spans[-1][1] and lines[a].box in boxes]
            spans = sorted(spans + between)
            first = spans[0][0]
            if first and lines[first - 1].title:
                spans[0] = (first - 1, spans[0][1])
    return "\n".join(x.text for a, b in spans for x in lines[a:b + 1])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the article's ``text`` and its code points ``n_chars``."""

    @F.arrow_udf("string")
    def run(pages_html: pa.Array) -> pa.Array:
        parts = [pa.array([main_text(h) for h in pages_html[at:at + STEP].to_pylist()], pa.string()) for at in range(0, len(pages_html), STEP)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, run(whole("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
