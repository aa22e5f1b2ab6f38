"""Main text of web pages by tag-path ratios.

A page's blocks of text are grouped by their path of tags from the root. For each path the text
length and the punctuation a block are taken, as they are and smoothed over the blocks in page
order, fused with the share of text that is no link, and held against a share of the best path's value. What the
page says of its own structure is part of a path's value: paths through menus, headers, footers,
sidebars, notices, adverts, forms and comments are worth nothing, and where a page has an article
or main element, paths outside count little. Paths that fall short but stand in one container
with the chosen ones (headings, captions, short lists) complete the text, unless they are links.

Defined results: a null or empty page, and one without main text, give an empty text. Markup that
is never closed ends with the page, and a tag cut off by the page's end is dropped. Character references are decoded once, in text only. <br> is white
space inside its block. Repeated rows give the same text each. A null page_id or url stays null.
Columns other than page_id, url and html are not read. No pages, no rows.

At scale: one pass over the pages, no shuffle; a task holds one Arrow batch of pages, whose size
the session's maxRecordsPerBatch bounds, and the parsed form of one page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements, and the words by which pages name their parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at the first end tag of their own.
RAW = set("script style textarea title iframe noembed noframes noscript".split())
BLOCK = set("address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Formatting that a parser carries over the blocks it is not closed in; it makes no path.
FORMAT = set("abbr b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small strike strong sub sup tt u var".split())
APART = set("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script search select style svg template textarea title".split())
APART_ROLE = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
APART_WORD = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail widget widgets header masthead topbar footer footers copyright legal "
    "comment comments commentlist disqus reply replies respond discussion form login signin signup subscribe subscription newsletter search share sharing social related recommended recommendations teaser teasers pager pagination toolbar".split()
)
#: An article is what it is, whatever its class says of its looks, unless it is one of these.
APART_ARTICLE = set("ad advert advertisement sponsored promo comment comments reply related recommended teaser".split())
#: The next of its kind closes one of these, up to the element that holds them.
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|</(?=[^A-Za-z])[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_NOT_P = BLOCK - {"p"}
_NONE: frozenset[str] = frozenset()

SMOOTHING = [math.exp(-(d * d) / 2.0) for d in range(-2, 3)]
#: A path is content from this share of the best path's value on.
SHARE = 0.05
#: The weight of paths outside an article, where the page has one.
OUTSIDE = 0.01
#: A path of which more is links does not complete a text.
MAX_LINKS = 0.5


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    apart: bool


@dataclass(slots=True)
class Block:
    element: int
    text: str
    links: int
    skipped: bool


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, False)])
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def up(self, at: int) -> list[int]:
        """An element and its ancestors."""
        out = []
        while at >= 0:
            out.append(at)
            at = self.elements[at].parent
        return out

    def step(self, path: int, to: str) -> int:
        """The number of the path one step on."""
        return self.paths.setdefault((path, to), len(self.paths) + 1)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's step in a path, and whether it says that it stands apart from the text."""
    apart, classes = tag in APART, ""
    if "=" in attributes and tag not in ("html", "body"):
        words = APART_ARTICLE if tag in ("article", "main") else set() if tag in HEADING else APART_WORD
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                apart |= value.strip().lower() in APART_ROLE
                continue
            if name == "class":
                classes = "." + ".".join(value.split())
            apart |= any(w.lower() in words for w in NAME_PART.findall(value))
    return tag + classes, apart


def parse(source: str) -> Page:
    """The page's elements and its blocks of text, in page order."""
    page, stack = Page(), [0]
    elements, blocks = page.elements, page.blocks
    parts: list[str] = []
    links = skipped = 0
    n_open: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links, skipped
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next(i for i in reversed(stack) if elements[i].tag in BLOCK or not i)
                blocks.append(Block(at, text, links, skipped > 0))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal skipped
        while len(stack) > depth:
            e = elements[stack[-1]]
            if e.tag in BLOCK:
                flush()
            elif e.apart:
                skipped -= 1
            n_open[e.tag] -= 1
            stack.pop()

    def found(tag: str, stops: set[str] | frozenset[str]) -> int:
        """The place of the nearest open tag on the stack, 0 if none before a stop."""
        for k in range(len(stack) - 1, 0, -1) if n_open[tag] else ():
            here = elements[stack[k]].tag
            if here == tag:
                return k
            if here in stops:
                return 0
        return 0

    def say(text: str) -> None:
        nonlocal links
        if not skipped and text:
            parts.append(text)
            if any(elements[i].tag == "a" for i in stack[-3:]):
                links += len(text.strip())

    at = 0
    for m in iter(lambda: TAG.search(source, at), None):
        if m.start() > at:
            say(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in FORMAT:
            continue
        if m[1]:
            k = found(tag, _NONE if tag in BLOCK else BLOCK)
            if k:
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            if k := found("p", _NOT_P):
                close(k)
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if tag in CLOSED_BY_SAME:
                k = max(found(t, CLOSED_BY_SAME[tag] | {"table"}) for t in same)
                if k:
                    close(k)
            flush()
        elif tag == "a" and (k := found("a", BLOCK)):
            close(k)
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        step, apart = _named(tag, m[3])
        parent = stack[-1]
        if tag == "header":
            apart |= not any(elements[i].tag in ("article", "main") for i in stack)
        elements.append(Element(tag, parent, page.step(elements[parent].path, step) if tag in BLOCK else elements[parent].path, apart))
        if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        stack.append(len(elements) - 1)
        n_open[tag] += 1
        if apart and tag not in BLOCK:
            skipped += 1
    if at < len(source):
        say(html.unescape(source[at:]))
    close(1)
    flush()
    return page


def containers(page: Page) -> tuple[set[int], set[int]]:
    """The elements that hold the page's article, and those that stand apart from it.

    What holds the first article or main element is not apart from it, though it be a form
    around the whole page or a menu that is never closed.
    """
    apart = {i for i, e in enumerate(page.elements) if e.apart}
    firm = {i for i in apart if page.elements[i].tag in ("aside", "footer")}
    for tag in ("article", "main"):
        own = [i for i, e in enumerate(page.elements) if e.tag == tag and i not in apart and not firm & set(page.up(i))]
        if own:
            apart -= set(page.up(own[0]))
            held = {i for i in own if not apart & set(page.up(i))}
            return held, apart
    return set(), apart


def smoothed(values: list[float]) -> list[float]:
    """Gaussian smoothing over neighbours in page order, with weights summing to one at the ends too."""
    half, out = len(SMOOTHING) // 2, []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in enumerate(SMOOTHING, -half) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def common_element(page: Page, of: list[int]) -> int:
    """The innermost element that holds the given ones, other than one of text alone."""
    line = page.up(of[0])[::-1]
    place, keep, seen = {e: i for i, e in enumerate(line)}, max(0, len(line) - 2), set()
    for at in of[1:]:
        while at not in place and at not in seen:
            seen.add(at)
            at = page.elements[at].parent
        keep = min(keep, place.get(at, keep))
    return line[keep]


def main_blocks(page: Page) -> list[Block]:
    held, apart = containers(page)
    within: dict[int, tuple[bool, bool]] = {-1: (False, False)}
    for i, e in enumerate(page.elements):  # parents come first
        inside, out = within[e.parent]
        within[i] = (inside or i in held, out or i in apart)
    blocks = [b for b in page.blocks if not b.skipped and not within[b.element][1]]
    if not blocks:
        return []
    key = lambda b: (page.elements[b.element].path, within[b.element][0])
    paths: dict[tuple, list[int]] = {}
    for b in blocks:
        p = paths.setdefault(key(b), [0, 0, 0, 0])
        p[0] += 1
        p[1] += len(b.text)
        p[2] += len(PUNCTUATION.findall(b.text))
        p[3] += b.links
    length = smoothed([paths[key(b)][1] / paths[key(b)][0] for b in blocks])
    marks = smoothed([paths[key(b)][2] / paths[key(b)][0] for b in blocks])
    sums: dict[tuple, list[float]] = {k: [0.0, 0.0] for k in paths}
    for b, x, y in zip(blocks, length, marks, strict=True):
        sums[key(b)][0] += x
        sums[key(b)][1] += y
    value = {}
    for k, (n, chars, points, linked) in paths.items():
        plain = max(0.0, 1.0 - linked / chars)
        value[k] = chars / n * (1.0 + points / n) * (sums[k][0] / n) * (1.0 + sums[k][1] / n) * plain * (1.0 if k[1] or not held else OUTSIDE)
    best = max(value.values())
    chosen = {k for k, v in value.items() if v > 0 and v >= SHARE * best}
    taken = [key(b) in chosen for b in blocks]
    heading = lambda b: page.elements[b.element].tag in HEADING
    completes = lambda b: heading(b) or paths[key(b)][3] <= MAX_LINKS * paths[key(b)][1]
    if held:
        return [b for b, t in zip(blocks, taken, strict=True) if t or within[b.element][0] and completes(b)]
    if not chosen:
        return []
    top = common_element(page, [b.element for b, t in zip(blocks, taken, strict=True) if t])
    if page.elements[top].tag in ("", "html", "body"):
        first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
        while first and heading(blocks[first - 1]):
            first -= 1
        return [b for i, b in enumerate(blocks) if taken[i] or first <= i <= last and completes(b)]
    below = {top}
    below |= {i for i, e in enumerate(page.elements) if e.parent in below and not below.add(i)}
    return [b for b, t in zip(blocks, taken, strict=True) if t or b.element in below and completes(b)]


def main_text_of(source: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(parse(source))) if source else ""


def _main_text(source: pd.Series) -> pd.Series:
    return pd.Series([main_text_of(s) for s in source], dtype=object)


def main_text(source: Column) -> Column:
    """The main text of a column of HTML."""
    return F.pandas_udf(_main_text, "string")(source)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page."""
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
