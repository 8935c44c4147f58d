"""HTML extraction: tag-path ratios, smoothed and fused, choose the content paths; their article is the main text."""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches

RAW = re.compile(r"<(script|style|noscript|template|iframe|textarea|svg|math|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

# never article text, by element, by role, and by a word of the class or id
OUT_TAGS = set("head nav header footer aside form button select menu dialog canvas audio video".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright dialog disclaimer disqus footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
STRONG = set("html body main article h1 h2 h3 h4 h5 h6".split())
ARTICLE_WORDS = set("comment comments reply ad ads advert promo sponsored related teaser".split())

SIGMA = 1.0


def _outside(tag: str, attributes: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in OUT_ROLES:
            return True
        if name in ("class", "id"):
            if tag not in STRONG and OUT_WORDS.intersection(re.split(r"[^a-z0-9]+", value)):
                return True
            if tag == "article" and ARTICLE_WORDS.intersection(value.split()):
                return True
    return False


class Page:
    """Blocks in page order and the tree of block elements above them; outside parts are left out.

    One pass over the tags with a stack; open paragraphs, items and cells end where the standard ends them.
    Elements and tag paths are numbers, so deep or unclosed mark-up costs no more than flat mark-up.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int]] = []  # element, text, linked characters
        self.tag, self.parent, self.path = [""], [0], [0]  # by element; 0 is the page
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, bool]] = []
        self._open: dict[str, int] = defaultdict(int)
        self._out, self._parts, self._linked = 0, [], 0
        html, at = COMMENT.sub("", RAW.sub(" ", html)), 0
        for m in TAG.finditer(html):
            self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                self._tag(m[2].lower(), bool(m[1]), m[3] or "")
        self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self._out:
            text = unescape(raw)
            self._parts.append(text)
            if self._open["a"]:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                at = next((k for t, k, _ in reversed(self._stack) if t not in INLINE), 0)
                self.blocks.append((at, text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _, outside in self._stack[at:]:
            self._open[tag] -= 1
            self._out -= outside
        del self._stack[at:]

    def _close(self, names: set, scope: set) -> None:
        if not any(self._open[t] for t in names):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in names:
                self._flush()
                self._pop(k)
                return
            if self._stack[k][0] in scope:
                return

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "br":
            self._parts.append(" ")
        elif closing and tag in INLINE:
            k = len(self._stack) - 1
            while k >= 0 and self._open[tag] and self._stack[k][0] in INLINE and self._stack[k][0] != tag:
                k -= 1
            if k >= 0 and self._stack[k][0] == tag:
                self._pop(k)
        elif closing:
            self._flush()
            self._close({tag}, set())
        else:
            outside = _outside(tag, attributes)
            if tag not in INLINE or outside:
                self._flush()
            if tag in CLOSES_P:
                self._close({"p"}, {"table", "button"})
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], SCOPES[tag])
            if tag not in VOID and not attributes.endswith("/"):
                self._push(tag, outside)

    def _push(self, tag: str, outside: bool) -> None:
        at = 0
        if tag not in INLINE:
            above = next((k for t, k, _ in reversed(self._stack) if t not in INLINE), 0)
            at = len(self.tag)
            self.tag.append(tag)
            self.parent.append(above)
            self.path.append(self._paths.setdefault((self.path[above], tag), len(self._paths) + 1))
        self._stack.append((tag, at, outside))
        self._open[tag] += 1
        self._out += outside


def path_scores(page: Page) -> dict[int, float]:
    """Fused ratio per tag path: characters per node times one plus punctuation per node, less what is linked."""
    nodes, chars, marks, links = (defaultdict(float) for _ in range(4))
    for element, text, linked in page.blocks:
        p = page.path[element]
        nodes[p] += 1
        chars[p] += len(text)
        marks[p] += len(PUNCTUATION.findall(text))
        links[p] += linked
    return {p: chars[p] / nodes[p] * (1 + marks[p] / nodes[p]) * (1 - links[p] / chars[p]) for p in nodes}


def content_flags(page: Page) -> tuple[list[bool], list[bool]]:
    """Smooth the fused path ratios over the page with a Gaussian; paths whose blocks reach the threshold on
    average, half the mean of all characters' smoothed ratios, are content. Of these blocks, the second list leaves
    out the lone block of a path that reaches it by its neighbours only."""
    score = path_scores(page)
    paths = [page.path[b[0]] for b in page.blocks]
    line = [score[p] for p in paths]
    reach = max(1, math.ceil(3 * SIGMA))
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(line)):
        near = [(kernel[d + reach], line[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(line)]
        smooth.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    sizes = [len(b[1]) for b in page.blocks]
    threshold = 0.5 * sum(s * n for s, n in zip(smooth, sizes)) / max(sum(sizes), 1)
    sums, counts = defaultdict(float), defaultdict(int)
    for s, p in zip(smooth, paths):
        sums[p] += s
        counts[p] += 1
    flags = [sums[p] / counts[p] >= threshold and score[p] > 0 for p in paths]
    return flags, [f and (counts[p] > 1 or score[p] >= threshold) for f, p in zip(flags, paths)]


def _common(page: Page, elements: set[int]) -> int:
    """Lowest element that is or lies above each of the elements; a child's number is above its parent's."""
    elements = set(elements)
    heap = [-k for k in elements]
    heapq.heapify(heap)
    while len(elements) > 1:
        elements.discard(last := -heapq.heappop(heap))
        if page.parent[last] not in elements:
            elements.add(page.parent[last])
            heapq.heappush(heap, -page.parent[last])
    return elements.pop()


def _outermost(page: Page) -> list[int]:
    """The outermost article or main element of each element, itself included; 0 for none."""
    top = [0]
    for k in range(1, len(page.tag)):
        top.append(top[page.parent[k]] or (k if page.tag[k] in ("article", "main") else 0))
    return top


def main_text(html: str | None) -> str:
    """Main text of one page: the blocks of the article that the content paths lie in, joined by \\n.

    The article is the nearest article or main element above the lowest element around all content paths' blocks;
    where one article or main element holds nine tenths of their text, only its blocks count. Without such an
    element it is the lowest element itself, or the one below body that also holds the last h1 before it, with the
    headings just before. Blocks in it that are links alone go. Null, empty and text-free pages give ''.
    """
    page = Page(html or "")
    blocks = page.blocks
    if not blocks:
        return ""
    unlinked = [linked < len(text) for _, text, linked in blocks]
    flags, anchors = content_flags(page)
    if not any(flags):
        flags = unlinked if any(unlinked) else [True] * len(blocks)
    if not any(anchors):
        anchors = flags
    top, held = _outermost(page), defaultdict(int)
    for (element, text, _), anchor in zip(blocks, anchors):
        held[top[element]] += len(text) * anchor
    marked = [k for k, n in held.items() if k and n]
    if len(marked) == 1 and held[marked[0]] >= 0.9 * sum(held.values()):
        anchors = [a and top[b[0]] == marked[0] for a, b in zip(anchors, blocks)]
    root = _common(page, {b[0] for a, b in zip(anchors, blocks) if a})
    article = root
    while article and page.tag[article] not in ("article", "main"):
        article = page.parent[article]
    if not article:
        if page.tag[root] in CLOSES_P - {"div", "section", "table"} | {"p", "li"}:
            root = page.parent[root]
        title = max((b[0] for b in blocks if page.tag[b[0]] == "h1" and b[0] < root), default=0)
        above = _common(page, {root, title}) if title else 0
        if above and page.tag[above] not in ("html", "body"):
            root = above
    root = article or root
    within = [k == root for k in range(len(page.tag))]
    for k in range(root + 1, len(within)):
        within[k] = within[page.parent[k]] or k == root
    inside = [i for i, b in enumerate(blocks) if within[b[0]]]
    first = inside[0]
    while not article and first and page.tag[blocks[first - 1][0]] in ("h1", "h2", "h3"):
        first -= 1
    wanted = [*range(first, inside[0]), *inside]
    return "\n".join(blocks[i][1] for i in wanted if flags[i] or unlinked[i])


def extract_main_text(html: Column) -> Column:
    """Column form of `main_text`, Arrow batches; a page is parsed where it is read, without a shuffle."""

    @F.pandas_udf("string")
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return parse(html)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` plus `text_col`. Repeated rows give repeated rows; a column of that name is replaced."""
    return bound_batches(pages).withColumn(text_col, extract_main_text(F.col(html_col)))
