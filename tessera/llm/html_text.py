"""Main text of web pages by consensus of a host's pages on where it stands."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .urls import host_of

#: Hosts whose winning paths are broadcast at most; beyond, pages are joined by host.
BROADCAST_HOSTS = 100_000
#: Containers that a page votes for.
VOTES = 3

#: A tag, a comment or a declaration. A quote opens a value only behind "=" ; where a value never ends, `bad` stands for the tag.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*))>|<(?P<bad>/?[a-zA-Z])", re.S
)
#: The same with every tag ended by its first ">".
_PLAIN_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>|<(?P<bad>(?!))", re.S)
_UNFINISHED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements whose content is no markup. CODE swallows the page where it is left open, as in browsers; the others then hold nothing.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
CODE = {"script", "style"}
#: Elements whose content is never shown as text; one without an end tag of its own holds nothing.
UNSHOWN = {"svg", "object", "canvas", "audio", "video", "select", "datalist", "button", "template", "annotation", "annotation-xml"}
_UNSHOWN_TAG = re.compile(rf"<(/?)({'|'.join(sorted(UNSHOWN, key=len, reverse=True))})(?=[\s/>])[^>]*>", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: A start tag ends an open element of these names (up to the nearest of the second set).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are not part of an article. Of these, one of WRAPPERS that holds the article is none.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
WRAPPERS = {"form", "fieldset", "header"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words in class and id that tell menus, headers, footers, sidebars, notices, adverts, forms and comments.
ASIDE_WORDS = {
    "ad", "ads", "adsense", "adslot", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "billboard", "bottombar", "breadcrumb", "breadcrumbs", "captcha",
    "consent", "contentinfo", "cookie", "cookies", "dropdown", "feedback", "footer", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "navi", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended",
    "related", "search", "share", "sharing", "sidebar", "signin", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "teaser", "toolbar",
    "topbar", "trending", "widget", "widgets",
}
COMMENT_WORDS = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond"}
#: What may follow a word of those in a name ("nav-list", "ad-300x250"); behind another word ("related-work") it tells nothing.
LAYOUT_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "container", "content", "entry", "footer", "form", "group", "header", "inner", "item", "items", "left", "link", "links", "list",
    "main", "outer", "panel", "primary", "right", "row", "secondary", "section", "slot", "tab", "tabs", "text", "thread", "title", "top", "unit", "wrap", "wrapper",
}
#: Names such as "has-comments" or "comments-open" tell a state.
STATE_WORDS = {"closed", "count", "disabled", "enabled", "has", "is", "no", "off", "on", "open", "with", "without"}
MAIN_WORDS = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "html", "center", "blockquote", "form", "fieldset"}
#: Inline elements that are left out at once if their name tells an aside.
INLINE = {"a", "b", "em", "font", "i", "ins", "label", "small", "span", "strong", "sub", "sup", "u"}
BESIDE = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"}


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: str  # stands for the generalised path: tags and classes from the root on, digits as #
    aside: bool
    worth: float
    comments: bool = False
    own_header: bool = False  # named as a header of an article
    size: int = 0  # characters of its text outside asides
    linked: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, text) in page order
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _tells(names: list[str], words: set[str]) -> bool:
    """If one of the names is of these words: ends with one, or has layout words behind it."""
    for name in names:
        parts = _WORDS.findall(name)
        if not parts or not words.intersection(parts) or STATE_WORDS.intersection((parts[0], parts[-1])):
            continue
        if parts[-1] in words or (parts[0] in words and all(p in LAYOUT_WORDS or p in words or p.isdigit() or len(p) == 1 for p in parts[1:])):
            return True
    return False


def _element(tag: str, attrs: str, parent: int, path: str) -> Element:
    values = {}
    for m in _ATTR.finditer(attrs) if attrs.strip(" /") else ():
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if not values:
        return Element(tag, parent, _deeper(path, tag), tag in ASIDE_TAGS, _WORTH.get(tag, 1.0))
    role = values.get("role", "").lower()
    names = _CAMEL.sub("-", f"{values.get('class', '')} {values.get('id', '')}").lower().split()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(values.get("style", "").lower())
    comments = tag not in ("html", "body", "main") and _tells(names, COMMENT_WORDS)
    aside = tag in ASIDE_TAGS or bool(hidden) or role in ASIDE_ROLES or comments
    if not aside and tag not in ("html", "body", "article", "main"):
        aside = _tells(names, ASIDE_WORDS)
    worth = _WORTH.get(tag, 1.0)
    words = set(_WORDS.findall(" ".join(names)))
    if worth == 1.0 and (words & MAIN_WORDS or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()):
        worth = 1.3
    own_header = any(parts[-1:] == ["header"] and MAIN_WORDS.intersection(parts[:-1]) - {"page", "main", "body"} for parts in map(_WORDS.findall, names))
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in values.get("class", "").lower().split()})
    return Element(tag, parent, _deeper(path, ".".join([tag, *classes])), aside, worth, comments, own_header)


_WORTH = {"article": 1.6, "main": 1.4, "body": 0.8, "html": 0.7}


def _deeper(path: str, label: str) -> str:
    """The path of a child: 128 bits, so that a path is as long at any depth."""
    return xxhash.xxh3_128_hexdigest(f"{path}>{label}")


def _left_open(html: str) -> set[int]:
    """Where start tags of UNSHOWN elements stand that no end tag closes."""
    open_: dict[str, list[int]] = {}
    for m in _UNSHOWN_TAG.finditer(html):
        name = m[2].lower()
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.setdefault(name, []).append(m.start())
        elif open_.get(name):
            open_[name].pop()
    return {at for starts in open_.values() for at in starts}


def parse(html: str) -> Page:
    """The elements of a page and its blocks of text, in time linear in its length. Tags left open or closed twice do no harm; a tag
    that the page ends in is no text, however long it is."""
    page = Page([Element("html", -1, "html", False, 0.7)])
    elements = page.elements
    stack, pending, pending_links, in_link = [0], [], 0, 0
    opened = Counter()  # names on the stack
    unshown: list[bool] = [False]  # for each element on the stack: if its text is left out
    left_open = _left_open(html)
    endless: set[str] = set()  # names without an end tag further on

    def flush() -> None:
        nonlocal pending, pending_links
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                page.blocks.append((stack[-1], text))
                elements[stack[-1]].size += len(text)
                elements[stack[-1]].linked += min(pending_links, len(text))
            pending = []
        pending_links = 0

    def close(depth: int) -> None:
        nonlocal in_link
        if any(elements[e].tag in BLOCKS for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            opened[elements[e].tag] -= 1
            in_link -= elements[e].tag == "a"
        del stack[depth:], unshown[depth:]

    def add(text: str) -> None:
        nonlocal pending_links
        if text and not unshown[-1]:
            pending.append(unescape(text))
            pending_links += len(text) if in_link else 0

    at, end, tag_at = 0, html.rfind(">") + 1, _TAG
    while at < end:
        m = tag_at.search(html, at, end)
        if not m:
            break
        if m["bad"]:
            tag_at = _PLAIN_TAG
            continue
        add(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = end = len(html)  # a comment that never ends
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in ("td", "th") and not unshown[-1]:
                pending.append(" ")
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == name:
                    close(depth)
                    break
                if name not in BLOCKS and elements[stack[depth]].tag in BLOCKS:
                    break  # the end of an inline element doesn't close a block
            continue
        if name in RAW:
            if m[0].endswith("/>") or name in endless:
                continue
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at, end)
            if stop:
                at = stop.end()
            elif name in CODE:
                at = end = len(html)
            else:
                endless.add(name)
            continue
        if name == "br" or name in ("td", "th"):
            if not unshown[-1]:
                pending.append(" ")
        if name == "hr":
            flush()
        if name in VOID or name in ("html", "head") or m.start() in left_open or (name in UNSHOWN and m[0].endswith("/>")):
            continue
        if name in IMPLIED:
            ends, within = IMPLIED[name]
            for depth in range(len(stack) - 1, 0, -1):
                tag = elements[stack[depth]].tag
                if tag in ends:
                    close(depth)
                    break
                if tag in within:
                    break
        if name in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):  # an open paragraph ends
                tag = elements[stack[depth]].tag
                if tag == "p":
                    close(depth)
                    break
                if tag in BLOCKS:
                    break
            flush()
        elements.append(_element(name, m["attrs"] or "", stack[-1], elements[stack[-1]].path))
        stack.append(len(elements) - 1)
        unshown.append(unshown[-1] or name in UNSHOWN or (name in INLINE and elements[-1].aside))
        opened[name] += 1
        in_link += name == "a"
    rest = html[at:] if at < len(html) else ""
    unfinished = _UNFINISHED.search(rest) if at >= end else None
    add(rest[: unfinished.start()] if unfinished else rest)
    close(1)
    flush()
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Which elements are asides, and sizes without them.

    An aside by its name, a form or a header is none if it holds an article or main element, or most of the page's text while
    little stands outside of asides. Comments are none only if they hold the main element or the h1. A header in an article is part of it.
    """
    elements = page.elements
    n = len(elements)
    total, linked, holds, core = [e.size for e in elements], [e.linked for e in elements], [False] * n, [False] * n
    inside_aside, in_article = [False] * n, [False] * n
    for i, e in enumerate(elements):
        in_article[i] = i > 0 and (in_article[e.parent] or elements[e.parent].tag in ("article", "main"))
        if (e.tag == "header" or e.own_header) and not e.comments and (in_article[i] or e.own_header):
            e.aside = False
        inside_aside[i] = e.aside or (i > 0 and inside_aside[e.parent])
        holds[i] = e.tag in ("article", "main") and not e.comments
        core[i] = e.tag in ("main", "h1")
    outside = sum(e.size - e.linked for i, e in enumerate(elements) if not inside_aside[i])
    for i in range(n - 1, 0, -1):
        e = elements[i]
        total[e.parent] += total[i]
        linked[e.parent] += linked[i]
        core[e.parent] |= core[i]
        if not e.comments:
            holds[e.parent] |= holds[i]
    for i, e in enumerate(elements):
        if i and elements[e.parent].aside:
            e.aside = True
        elif e.aside and e.comments:
            e.aside = not core[i]
        elif e.aside and (e.tag not in ASIDE_TAGS or e.tag in WRAPPERS):
            e.aside = not (holds[i] or (2 * total[i] > total[0] > 0 and 4 * outside < total[i] - linked[i]))
    for i in range(n - 1, 0, -1):
        e = elements[i]
        if not e.aside:
            elements[e.parent].size += e.size
            elements[e.parent].linked += e.linked


def containers(page: Page) -> list[tuple[float, int]]:
    """(score, element) of what may hold the article, best first; of equals the innermost."""
    scored = [
        (e.worth * max(0.0, e.size - 1.5 * e.linked), i)
        for i, e in enumerate(page.elements)
        if e.tag in CONTAINERS and not e.aside and e.size
    ]
    return sorted(scored, reverse=True)


def votes(page: Page) -> list[tuple[str, float]]:
    """(path, share of the best score) of the page's best containers; a path stands as 128 bits."""
    best = containers(page)[:VOTES]
    top = best[0][0] if best else 0.0
    return [(page.elements[i].path, s / top) for s, i in best] if top > 0 else []


def extract(page: Page, path: str | None) -> str:
    """The text in the elements at the path, or, where the page has none with text there, in its own best container.

    Headings, paragraphs and lists beside such an element belong to it: those before it, and, below the body, those behind.
    """
    elements = page.elements
    found: set[int] = set()
    if path:
        found = {i for i, e in enumerate(elements) if e.path == path and e.size and not e.aside}
        found = {i for i in found if elements[i].size > 1.5 * elements[i].linked} or found
    if not found:
        best = containers(page)
        found = {best[0][1]} if best else {0}
    parents = {elements[i].parent for i in found}
    last = {elements[i].parent: i for i in sorted(found)}
    beside = {
        i
        for i, e in enumerate(elements)
        if e.parent in parents and e.tag in BESIDE and not e.aside and e.size > 2 * e.linked and (i < last[e.parent] or elements[e.parent].tag not in ("body", "html"))
    }
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i in found or i in beside or (i > 0 and inside[e.parent])
    return "\n".join(text for i, text in page.blocks if inside[i] and not elements[i].aside)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; others are ignored).

    Each page votes for the generalised paths (tags and classes, digits as #) of its best containers; the path with the
    most votes of a host wins, and its pages are extracted there. A page without that path, or without host, goes by its own
    best container. White space in a block is one space, blocks are joined by \\n. Null and empty html give an empty text, rows with
    equal page_id or url are extracted each. A page is read in time linear in its length, however long or deep it is. A tag or comment that the page ends in, and
    what stands behind an open script or style, is no text; other elements left open hide nothing behind them.
    """
    ws = Workspace(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, share in votes(parse(html.as_py() or "")):
                    sums[host, path] = sums.get((host, path), 0.0) + round(share * 1000)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([int(v) for v in sums.values()], pa.int64())], names=["host", "path", "votes"])

    found = rows.where("host <> ''").select("host", "html").mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = ws.put(found.groupBy(F.col("host").alias("of")).agg(F.max(F.struct("votes", "path"))["path"].alias("path")), "winners")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(html.as_py() or ""), path) for html, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    both = rows.join(winners, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "path")
    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
