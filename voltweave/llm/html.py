"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events once. Block tags end a line; a line has its text and
the tags met since the last one. Lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, by their tags, roles and names, have the ratio zero; so have lines of scripts and styles. The logarithms of
the smoothed ratios of characters to tags are split into two clusters, a ratio of zero being in the low one. A
container that holds a line of the high cluster is a content region, however small its share, and all its
lines above zero are kept, in page order. So are the other lines of the smallest container around all content
regions, for a short section between long ones is content too; there, lines that are mostly links are menus and go.

A class or id names boilerplate as a whole token only: one of the listed names, or several joined by hyphens or
underscores that are all listed or say nothing of their own (`site-footer`, but not `has-sidebar`).

Defined cases: a null or empty page has an empty text; a page without markup is one line; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"

# Tag and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main nav ol option p pre script section select style summary table tbody td textarea tfoot th thead title tr ul".split())
DROPPED = frozenset("nav footer aside form script style noscript template button select textarea svg iframe object canvas head title dialog header".split())
REGION = frozenset("article main section div td body html blockquote".split())
NESTED = REGION | DROPPED | frozenset("ul ol table dl figure".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that say nothing of their own beside such a name.
NEUTRAL = frozenset("article bar block bottom box container content entry global inner item items left list main module outer page panel post posts primary reader right secondary section site top unit user wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
#: Width of the Gaussian in lines.
SIGMA = 1.0
#: Clusters whose mean ratios are closer than this factor are one: a page of text alone has no low cluster.
APART = 4.0


@lru_cache(1 << 12)
def names_boilerplate(value: str) -> bool:
    """Whether a token of a class or id attribute names boilerplate."""
    for token in value.lower().split():
        parts = [x for x in token.replace("_", "-").split("-") if x]
        if token in BOILERPLATE or any(x in BOILERPLATE for x in parts) and all(x in BOILERPLATE or x in NEUTRAL or x.isdigit() for x in parts):
            return True
    return False


class Lines(HTMLParser):
    """lines: (text, tags, region, best region, dropped, mostly links). A region is a number in order of its start; parent: the region around each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        self.open: list[tuple[str, bool, int, int]] = [("", False, 0, -1)]  # tag, dropped, region, enclosing article or main
        self.parts: list[str] = []
        self.parent = [-1]
        self.tags = self.linked = 0
        self.link = False

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, dropped, region, best = self.open[-1]
                self.lines.append((text, self.tags, region, best, dropped, 2 * self.linked > len(text)))
                self.tags = 0
            self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            if tag == "br":
                self.parts.append(" ")
            else:
                self.end_line()
        self.tags += 1
        if tag == "a":
            self.link = any(key == "href" for key, _ in attrs)
        if tag in VOID:
            return
        top, dropped, region, best = self.open[-1]
        if tag == top and tag not in NESTED:  # a paragraph or item that was never closed
            self.open.pop()
            _, dropped, region, best = self.open[-1]
        named = False
        if attrs and tag not in ("main", "body", "html"):
            for key, value in attrs:
                if key in ("class", "id") and value:
                    named = named or names_boilerplate(value)
                elif key == "role" or key == "aria-hidden":
                    named = named or (value or "").lower() in (ROLES if key == "role" else ("true",))
                elif key == "hidden":
                    named = True
        out = named or tag in DROPPED and not (tag == "header" and best >= 0)
        if tag in NESTED or out:
            if tag in REGION:
                self.parent.append(region)
                region = len(self.parent) - 1
            if tag in ("article", "main") and not (tag == "main" and best >= 0):
                best = region
            self.open.append((tag, dropped or out, region, best))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.parts.append(" ") if tag == "br" else self.end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        if tag == "a" or tag in BLOCK:  # also where a link was never closed
            self.link = False
        self.tags += 1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.link:
            self.linked += len(" ".join(data.split()))


def parse(page: str) -> tuple[list[tuple[str, int, int, int, bool, bool]], list[int]]:
    for text in (page, page.replace("<![", "&lt;![")):
        parser = Lines()
        try:
            parser.feed(text)
            parser.close()
        except AssertionError:  # a marked section that the parser refuses; read as text instead
            continue
        parser.end_line()
        return parser.lines, parser.parent
    return [], [-1]


def smooth(values: np.ndarray) -> np.ndarray:
    """A Gaussian mean over neighbouring lines, renormalised at the ends."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def high_cluster(values: np.ndarray) -> np.ndarray:
    """The upper of two clusters of ratios above zero, by alternating means of their logarithms and the midpoint; all of them where there is one value or cluster."""
    above = values > 0
    logs = np.log1p(values[above])
    if not len(logs):
        return above
    upper, low, high = np.ones(len(logs), bool), logs.min(), logs.max()
    if low < high:
        limit = (low + high) / 2
        for _ in range(50):
            upper = logs >= limit
            new = (logs[upper].mean() + logs[~upper].mean()) / 2
            if new == limit:
                break
            limit = new
        upper = logs >= limit
        if logs[upper].mean() - logs[~upper].mean() < np.log(APART):
            upper = np.ones(len(logs), bool)
    out = above.copy()
    out[above] = upper
    return out


def around(regions: set[int], parent: list[int]) -> set[int]:
    """The smallest region that contains all of these, and all regions in it. A region's number is above its parent's."""
    left = set(regions)
    while len(left) > 1:
        last = max(left)
        left.remove(last)
        left.add(parent[last])
    inside = left
    for k in range(min(left) + 1, len(parent)):
        if parent[k] in inside:
            inside.add(k)
    return inside


def extract(page: str | None) -> str:
    lines, parent = parse(page or "")
    if not lines:
        return ""
    dropped, links = np.array([x[4] for x in lines]), np.array([x[5] for x in lines])
    ratio = np.where(dropped, 0.0, [len(text) / max(tags, 1) for text, tags, *_ in lines])
    level = np.where(dropped, 0.0, smooth(ratio))
    high = high_cluster(level)
    if not high.any():
        return ""
    own = ~links | (ratio >= level[high].min())  # a line of links counts by itself, not by the text beside it
    home = [best if best >= 0 else region for _, _, region, best, _, _ in lines]
    content = {x for x, h in zip(home, high & own, strict=True) if h} or {x for x, h in zip(home, high, strict=True) if h}
    inside = around(content, parent)
    kept = high | (level > 0)
    return " ".join(line[0] for line, x, k, link in zip(lines, home, kept, links, strict=True) if k and (x in content or x in inside and not link))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page; needs page_id, url and html, ignores all other columns."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, SCHEMA)
