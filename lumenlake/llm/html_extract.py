"""Main text of web pages by tag-path ratios.

A page is read once into *blocks*: runs of text between block-level tags, each in an
element with a path of tags (and class names) from the root to it.  Blocks of one path
are summed: their mean text length (text to tag-path ratio) and their mean number of
sentence marks, both times the share of text that is in no link.  The ratios are given
back to the blocks, smoothed along the page with a Gaussian, and fused by their
geometric mean with a third signal: NAMED, if an element around the block is by its
kind or name no article (navigation, forms, page headers and footers, asides, elements
named as advert, notice, comment section and the like, hidden ones), and BESIDE, if the
page has an article or main element and the block is outside it.

A path's score is the mean of its blocks.  Paths of at least STRONG of the best score
are strong, and the element that holds nearly all of their text is the article.  Inside
it a block stays unless one of the signals rejects its path: by a name, or because all
but a LINKED share of the path's text is in links (menus, related articles).  Length
does not count there, so headings and short paragraphs stay beside long ones.  Where
names would reject everything they change nothing, and an element that holds most of the
page's text is not judged by its name at all.

Reading is linear in the page: a tag's end is searched once, an end tag finds its start
by the open elements of its kind, and paths are nodes of a tree, not lists.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenlake.llm import shared

#: Paths of this share of the best path's score say where the article is.
STRONG = 0.35
#: Inside the article a path needs this share of its text outside links.
LINKED = 0.05
#: What the signal of names leaves of a score.
NAMED, BESIDE = 0.01, 0.1
#: An element with these shares of the page's text (in no link) is not judged by its name; the second one is for reader comments.
MOSTLY, ALMOST_ALL = 0.6, 0.9
#: Standard deviation, in blocks, of the smoothing.
SIGMA = 1.0
#: The article is the smallest element with this share of the strong paths' text.
COVER = 0.9

_RAW = frozenset("script style noscript template textarea iframe svg math object canvas title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Kinds of elements that are no part of an article.
_OUTSIDE = frozenset("nav footer aside form button select option fieldset dialog menu head datalist output meter progress audio video map".split())
_MAIN = frozenset(("article", "main"))
#: Elements that hold one paragraph, heading or item.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th figcaption caption address summary".split())
#: Words in class, id or role that name such a part.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side widget widgets footer masthead topbar toolbar "
    "share sharing social feedback related recommended recommendations "
    "teaser teasers newsletter subscribe subscription signup login search pagination pager copyright legal disclaimer skip complementary contentinfo form dialog status tablist".split()
)
_TALK = frozenset("comment comments commentary disqus reply replies respond discussion".split())
#: Beginnings of such words that stand in longer ones as well (cookiebar, commentlist).
_STEMS = re.compile("cookie|advert|sponsor|sidebar|newsletter|subscri|breadcrumb|footer|consent|navbar|popup|disclaimer|paginat|masthead|navigat")
#: Words that say an element is arranged around such a part, or lacks it.
_AROUND = frozenset("no with has without layout wrapper container page main content body site grid row".split())
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？、¿¡]")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>]|=\s*(["'])""")
#: Start tags that close an open element of the same kind first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_PLAIN, _NAMED_OUT, _TALKS, _HIDDEN = range(4)


def attributes(text: str) -> dict[str, str]:
    """Names (lower case) and values of a tag's attributes."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def kind_of(tag: str, text: str, inside_main: bool) -> int:
    """What an element is by its kind, names and attributes."""
    if tag in _OUTSIDE or (tag == "header" and not inside_main):
        return _NAMED_OUT
    if not text or tag in ("html", "body", "main", "article"):
        return _PLAIN
    found = attributes(text)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return _HIDDEN
    for attribute in ("class", "id", "role"):
        for name in found.get(attribute, "").split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & _AROUND:
                continue
            if words & _TALK or any(w.startswith("comment") for w in words):
                return _TALKS
            if words & _NAMES or any(_STEMS.search(w) for w in words) or ("header" in words and not inside_main):
                return _NAMED_OUT
    return _PLAIN


@dataclass
class Page:
    """Blocks (text, characters in links, element) and elements (parent, tag, kind, path), in page order; element 0 is the page."""

    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    element: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    kind: list[int] = field(default_factory=lambda: [_PLAIN])
    path: list[int] = field(default_factory=lambda: [0])


class _Open:
    """The open elements; those of one tag, and the blocks that no paragraph or inline element is, by their places."""

    def __init__(self):
        self.items: list[tuple[str, int]] = []  # tag, element (that of the block around an inline one)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hard: list[int] = []

    def push(self, tag: str, element: int) -> None:
        at = len(self.items)
        self.items.append((tag, element))
        self.places.setdefault(tag, []).append(at)
        if tag not in _INLINE:
            self.blocks.append(at)
            if tag != "p":
                self.hard.append(at)

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def close(self, at: int) -> None:
        while len(self.items) > at:
            tag, _ = self.items.pop()
            self.places[tag].pop()
            for stack in (self.blocks, self.hard):
                if stack and stack[-1] == len(self.items):
                    stack.pop()

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))


def read(html: str) -> Page:
    """The page's blocks and elements; text has its references decoded and white space folded."""
    page, stack, paths = Page(), _Open(), {}
    parts: list[str] = []
    linked = 0
    last = html.rfind(">")
    ends = {q: html.rfind(q) for q in "\"'"}
    lower = None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.texts.append(text)
                page.linked.append(min(linked, len(text)))
                page.element.append(stack.items[-1][1] if stack.items else 0)
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece:
            parts.append(piece)
            if stack.count("a"):
                linked += len(piece.strip())

    def tag_end(i: int) -> int:
        """Place of the '>' that ends the tag; values in quotes may hold others, an open quote is a character."""
        while True:
            m = _STOP.search(html, i)
            if m[0] == ">":
                return m.start()
            i = m.end()
            if ends[m[1]] >= i:
                i = html.index(m[1], i) + 1
                if i > last:  # the quote swallows the last '>': it is none
                    i = m.end()

    at = 0
    while True:
        mark = html.find("<", at)
        if mark < 0:
            break
        if html.startswith("<!--", mark):
            say(html[at:mark])
            at = html.find("-->", mark + 4)
            at = len(html) if at < 0 else at + 3
            continue
        if html.startswith("<![CDATA[", mark):
            say(html[at:mark])
            end = html.find("]]>", mark)
            say(html[mark + 9 : len(html) if end < 0 else end].replace("&", "&amp;"))
            at = len(html) if end < 0 else end + 3
            continue
        if mark >= last:  # no tag ends after this
            break
        if html[mark + 1] in "!?" or (html[mark + 1] == "/" and not html[mark + 2].isalpha()):
            say(html[at:mark])
            at = html.index(">", mark) + 1
            continue
        m = _TAG.match(html, mark + 1)
        if m is None:
            say(html[at : mark + 1])
            at = mark + 1
            continue
        say(html[at:mark])
        tag = m[2].lower()
        end = tag_end(m.end())
        text = html[m.end() : end]
        at = end + 1
        if tag in _RAW and not m[1]:
            if not text.endswith("/"):
                lower = lower if lower is not None else html.lower()
                close = lower.find("</" + tag, at) if len(lower) == len(html) else html.find("</" + tag, at)
                close = len(html) if close < 0 else html.find(">", close)
                at = len(html) if close < 0 else close + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in _VOID or tag in _RAW:
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if m[1]:
            place = stack.last(tag)
            # a stray inline end does not close blocks
            if place >= 0 and not (inline and stack.blocks and stack.blocks[-1] > place):
                if inline and stack.items[place][1] != (stack.items[place - 1][1] if place else 0):
                    flush()
                stack.close(place)
            continue
        around = stack.items[-1][1] if stack.items else 0
        if inline:
            if not (text.endswith("/") and tag not in ("span", "a")):
                kind = kind_of(tag, text, False) if text else _PLAIN
                if kind == _HIDDEN:  # its text is a block of its own
                    flush()
                    around = _element(page, paths, around, tag, text, kind)
                stack.push(tag, around)
            continue
        hard = stack.hard[-1] if stack.hard else -1
        closes = _CLOSES.get(tag)
        if closes is None:
            if stack.last("p") > hard:
                stack.close(stack.last("p"))
        elif hard >= 0 and stack.items[hard][0] in closes:
            stack.close(hard)
        around = stack.items[-1][1] if stack.items else 0
        if text.endswith("/") and tag not in ("p", "div"):
            continue
        inside = stack.count("article") + stack.count("main") > 0
        stack.push(tag, _element(page, paths, around, tag, text, kind_of(tag, text, inside)))
    say(html[at:])
    flush()
    return page


def _element(page: Page, paths: dict, parent: int, tag: str, text: str, kind: int) -> int:
    name = attributes(text).get("class", "") if text else ""
    label = (page.path[parent], tag, re.sub(r"\d+", "", name))
    page.parent.append(parent)
    page.tag.append(tag)
    page.kind.append(kind)
    page.path.append(paths.setdefault(label, len(paths) + 1))
    return len(page.parent) - 1


def _inherited(page: Page, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over each element and all in it; elements follow their parents."""
    out = own.tolist()
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e]
    return np.array(out)


def _within(page: Page, start: np.ndarray) -> np.ndarray:
    """Whether an element or one around it is in ``start``."""
    out = start.tolist()
    for e in range(1, len(out)):
        out[e] = out[e] or out[page.parent[e]]
    return np.array(out)


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the score of its path (smoothed and fused ratios), and whether no signal rejects it inside an article."""
    at = np.array(page.element)
    chars = np.array([len(t) for t in page.texts], float)
    marks = np.array([len(_MARKS.findall(t)) for t in page.texts], float)
    free = chars - np.array(page.linked, float)
    path = np.unique(np.array(page.path)[at], return_inverse=True)[1]
    blocks = np.bincount(path)
    total = np.bincount(path, chars)
    prose = (np.bincount(path, free) / total)[path]
    signals = [(total / blocks)[path] * prose, (1 + np.bincount(path, marks) / blocks)[path] * prose]
    reach = int(math.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    kernel /= kernel.sum()
    smooth = [np.convolve(np.pad(x, reach, mode="edge"), kernel, "valid") for x in signals]
    # by names: elements that hold most of the page's text are what they are
    kind = np.array(page.kind)
    share = _inherited(page, np.bincount(at, free, len(kind))) / max(1.0, free.sum())
    judged = (kind == _HIDDEN) | ((kind == _NAMED_OUT) & (share < MOSTLY)) | ((kind == _TALKS) & (share < ALMOST_ALL))
    out = _within(page, judged)
    main = _within(page, np.array([t in _MAIN for t in page.tag])) & ~out
    names = np.where(out, NAMED, 1.0) * np.where(main | ~main[at].any(), 1.0, BESIDE)
    fused = np.sqrt(smooth[0] * smooth[1]) * np.sqrt(prose) * names[at]
    return (np.bincount(path, fused) / blocks)[path], ~out[at] & (prose > LINKED)


def content(page: Page) -> list[str]:
    """The blocks of the article: those inside the element of the strong paths that nothing rejects, and the strong ones there."""
    if not page.texts:
        return []
    score, clear = path_scores(page)
    best = score.max()
    if best <= 0:
        return []
    strong = score >= STRONG * best
    at = np.array(page.element)
    chars = np.array([len(t) for t in page.texts], float)
    weight = _inherited(page, np.bincount(at[strong], chars[strong], len(page.parent)))
    holder = max(e for e in range(len(weight)) if weight[e] >= COVER * weight[0] and page.tag[e] not in _LEAVES)
    up = holder
    while up:  # an article is taken whole
        if page.tag[up] in _MAIN:
            holder = up
            break
        up = page.parent[up]
    start = np.zeros(len(page.parent), bool)
    start[holder] = True
    inside = _within(page, start)[at]
    return [t for t, ok in zip(page.texts, inside & (strong | clear), strict=True) if ok]


def main_text(html: str | None) -> str:
    """The article of a page as one line; empty if there is none."""
    return " ".join(content(read(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars (code points); one row per input row.

    Whole pages; a null or empty html, and one without an article, has an empty
    text.  Other columns are ignored, repeated rows kept.  Each page is read by
    itself, so nothing shuffles and a lost task is just run again.
    """

    def run(batches):
        for batch in batches:
            size, begin, texts = 0, 0, []
            for i, html in enumerate(batch.column(2)):
                texts.append(main_text(html.as_py()))
                size += len(texts[-1])
                if size >= 4 << 20 or i + 1 == batch.num_rows:
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    size, begin, texts = 0, i + 1, []

    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", pages.schema["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return shared.map_arrow(pages.select("page_id", "url", "html"), run, schema)
