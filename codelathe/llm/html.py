"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block.
A line's ratio is its characters over its tags; ratios are smoothed with a
Gaussian kernel and split into two clusters, whose midpoint is the threshold.
The lines above it are seeds. The container that holds their text is the content
region: all outermost article and main elements, where they have half of that
text together, or else the innermost element with all of it, or the body's
stretch from the first seed to the last with all of each element in the body
that holds seeds.
A region without article or main then grows to each element around it that adds
no frame of the page (menu, header, footer, sidebar), and over the headings and
paragraphs before and after it up to other text. All lines of the region are
content, short ones too, but for those in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments inside it, and for blocks of links
that are not above the threshold. What it grows over leaves out lists of links.

Defined results: null or empty html gives an empty text. Unclosed elements end
with the element around them. Character references are decoded, white space in
a line becomes one blank.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codelathe.llm.common import opened, table, with_struct

SIGMA = 1.0
RADIUS = 2

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

CONTAINERS = frozenset("html body main article section div header footer nav aside form fieldset dialog menu ul ol dl table tbody thead tfoot tr td th figure blockquote details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption option legend".split())
NEVER = frozenset("head title script style noscript template iframe object svg canvas select textarea button".split())
ASIDE = frozenset("nav aside footer form fieldset dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert newsletter subscribe subscription popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond share sharing social related recommended widget pagination toolbar login signup".split()
)
#: Of these, the ones around the content; others are inside it as often.
FRAME = frozenset("nav aside footer header menu".split())
FRAME_WORDS = frozenset("sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer banner".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODY = frozenset(("", "html", "body"))
#: Blocks of running text; a text directly in the body is one too.
PROSE = HEADINGS | BODY | frozenset("p pre li dt dd blockquote figcaption caption address summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Lines of a page with their tags and containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.places: list[int] = []
        self.kinds: list[str] = []
        self.linked: list[int] = []
        self.parents, self.names, self.aside, self.frame = [-1], [""], [False], [False]
        self.stack = [0]
        self.muted: list[str] = []
        self.parts: list[str] = []
        self.count = 0
        self.block, self.anchor, self.links = "", False, 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.count:
            self.texts.append(text)
            self.tags.append(self.count)
            self.places.append(self.stack[-1])
            self.kinds.append(self.block)
            self.linked.append(self.links)
        self.parts, self.count, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.muted:
            if tag == self.muted[-1] and tag not in VOID:
                self.muted.append(tag)
            elif self.muted[-1] == "head" and tag in ("body", "article", "main", "div", "p", "h1"):  # an unclosed head
                self.muted.clear()
            else:
                return
            if self.muted:
                return
        if tag in NEVER:
            self.muted.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.end_line()
            self.block = tag
            if tag in CONTAINERS:
                aside = self.is_aside(tag, attrs)
                self.parents.append(self.stack[-1])
                self.names.append(tag)
                self.aside.append(self.aside[self.stack[-1]] or aside)
                self.frame.append(self.frame[self.stack[-1]] or aside and self.is_frame(tag, attrs))
                self.stack.append(len(self.names) - 1)
        elif tag == "a":
            self.anchor = True
        self.count += 1

    def is_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ASIDE:
            return True
        if tag == "header":
            return not any(self.names[k] in ("article", "main") for k in self.stack)
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ASIDE_ROLES:
                return True
            if name in ("class", "id") and value and not ASIDE_WORDS.isdisjoint(_NAMES.findall(value.lower())):
                return True
        return False

    def is_frame(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag in FRAME or any(name == "role" and value in ASIDE_ROLES or name in ("class", "id") and value and not FRAME_WORDS.isdisjoint(_NAMES.findall(value.lower())) for name, value in attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in NEVER:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.muted:
            if tag == self.muted[-1]:
                self.muted.pop()
            return
        if tag in BLOCKS:
            self.count += 1
            self.end_line()
            if tag in CONTAINERS:
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.names[self.stack[depth]] == tag:
                        del self.stack[depth:]
                        break
            self.block = self.names[self.stack[-1]]
        else:
            self.anchor = self.anchor and tag != "a"
            self.count += 1

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.parts.append(data)
            if self.anchor:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian average over neighbouring lines; weights at the ends are renormalised."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    pad = np.pad(ratios, radius)
    there = np.pad(np.ones(len(ratios)), radius)
    return np.convolve(pad, kernel, "valid") / np.convolve(there, kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """Midpoint of the centres of two clusters (one-dimensional k-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    if low == high:
        return low - 1
    for _ in range(50):
        middle = (low + high) / 2
        below, above = values[values <= middle], values[values > middle]
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def region(page: Lines) -> list[int]:
    """Numbers of the content lines."""
    texts = page.texts
    good = np.array([bool(t) and not page.aside[k] for t, k in zip(texts, page.places)], bool)
    if not good.any():
        return []
    sizes = np.array([len(t) if g else 0 for t, g in zip(texts, good)], float)
    soft = smoothed(sizes / np.maximum(1, np.array(page.tags)))
    limit = threshold(soft)
    seeds = good & (soft > limit)
    if not seeds.any():
        seeds = good
    mass = np.zeros(len(page.names))
    for n in np.flatnonzero(seeds).tolist():
        k = page.places[n]
        while k >= 0:
            mass[k] += sizes[n]
            k = page.parents[k]
    total = mass[0]
    named = [k for k, x in enumerate(page.names) if x in ("article", "main") and not page.aside[k]]
    outer = [k for k in named if not any(p in named for p in _above(page, k))]
    if sum(mass[k] for k in outer) >= 0.5 * total:
        return sorted(n for k in outer for n in _inside(page, good, k) if soft[n] > limit or not _menu(page, n))
    return _unnamed(page, good, seeds, mass)


def _unnamed(page: Lines, good: np.ndarray, seeds: np.ndarray, mass: np.ndarray) -> list[int]:
    """The region where no article or main has most of the seeds."""
    best = max(np.flatnonzero(mass >= mass[0]).tolist(), key=lambda k: (len(_above(page, k)), -k))
    at = np.flatnonzero(seeds)
    lines = set(_inside(page, good, best))
    if page.names[best] in BODY:
        tops = {n: next((k for k in reversed([page.places[n], *_above(page, page.places[n])]) if page.names[k] not in BODY), None) for n in lines}
        held = {tops[n] for n in at.tolist()} - {None}
        lines = {n for n in lines if at[0] <= n <= at[-1] or tops[n] in held}
    else:
        chain = [k for k in _above(page, best) if page.names[k] not in BODY]
        order, added = {k: i for i, k in enumerate(chain)}, [[] for _ in chain]
        for n, text in enumerate(page.texts):
            if text and n not in lines:
                i = next((order[k] for k in [page.places[n], *_above(page, page.places[n])] if k in order), None)
                if i is not None:
                    added[i].append(n)
        for new in added:
            if any(page.frame[page.places[n]] for n in new):
                break
            lines.update(n for n in new if good[n] and not _menu(page, n))
    first, last = min(lines), max(lines)
    for side in (range(first - 1, -1, -1), range(last + 1, len(good))):
        for n in side:
            if good[n] and not _menu(page, n):
                if page.kinds[n] not in PROSE:
                    break
                lines.add(n)
    return sorted(lines)


def _inside(page: Lines, which: np.ndarray, k: int) -> list[int]:
    return [n for n in np.flatnonzero(which).tolist() if k == page.places[n] or k in _above(page, page.places[n])]


def _menu(page: Lines, n: int) -> bool:
    """Whether a line that is no heading or paragraph is mostly links."""
    return page.kinds[n] not in HEADINGS and page.kinds[n] != "p" and 2 * page.linked[n] > len(page.texts[n])


def _above(page: Lines, k: int) -> list[int]:
    out, k = [], page.parents[k]
    while k >= 0:
        out.append(k)
        k = page.parents[k]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return "\n".join([page.texts[n] for n in region(page)])


def extract(df: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """``df`` plus a struct of the main text and its length in code points."""

    def step(array: pa.Array) -> pa.StructArray:
        found = [main_text(x) for x in array.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], RESULT.names)

    return with_struct(df, html, RESULT, lambda: step, "main")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return opened(df, ["page_id", "url"], out)
