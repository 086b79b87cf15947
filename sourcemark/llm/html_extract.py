"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams its events. Text of one block is a line; its ratio is its characters
over its tags, 0 inside menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments. These are told by tag and role, by classes and ids that name nothing else ('main-menu'), and by a
word for comments, adverts, notices, menus or sign-ups anywhere in a class ('reader-comments'), but for states
('has-sidebar'). An element told by its name that holds most of the page's dense text is a wrapper and stays;
comments never do, nor what is named as a notice, advert, teaser or footer alone.

The ratios are smoothed with a Gaussian, and lines at or above the threshold (the deviation of the smoothed ratios)
are content, with the lines just before and after them that are not links alone. On a page that marks
article or main parts with text, the outermost marked parts that hold content are the region. Elsewhere the region is
the innermost element around all content; lines of links alone at its edges are navigation and go. All
other lines of the region outside excluded elements are the text, also short ones, in page order.

Scale: one pass, no shuffle; a page is parsed once and takes time in proportion to its length, however
deeply its elements are nested; a task holds one page at a time besides its Arrow batch.

Edge cases: null or empty html, and a page without content, give an empty text. Unclosed and
stray tags, cut-off pages and cut-off character references are read as the parser leaves them. A page of links alone is
its links. Repeated rows give repeated rows, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
) - {"br"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that never belong to the text, whatever they are called.
OUTSIDE = frozenset(
    "head title nav header footer aside script style noscript template iframe object svg math canvas audio "
    "video select option button textarea dialog menu input label fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words that name such an element, where a whole class or id is made of them and of PARTS.
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header masthead topbar toolbar "
    "footer colophon copyright sidebar sidebars aside rail widget widgets related recommended recommendations teaser "
    "notice notices cookie cookies consent gdpr banner alert popup modal overlay disclaimer newsletter subscribe "
    "subscription signup login search share sharing social comment comments commentlist discussion disqus reply replies "
    "respond form".split()
)
# Words that say which or what part of a named element; never enough by themselves.
PARTS = frozenset(
    "site page global main top bottom left right upper lower primary secondary inner outer box bar area list item items "
    "link links button buttons icons block blocks container wrap wrapper section region panel zone slot unit group "
    "post posts entry article articles thread title text message info the by my js id in on of and a".split()
)
# Short words that deny a name or make it a state; others of two letters are prefixes.
DENIED = frozenset("no is un".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus reply replies".split())
# Words that are also subjects: ids of headings and sections of an article.
SUBJECTS = frozenset(
    "discussion search related recommended notice notices form share sharing social navigation menu alert advertising "
    "advertisement promotion subscription copyright disclaimer consent cookie cookies login signup reply respond header "
    "overlay popup banner rail aside nav pagination newsletter sponsor".split()
)
# Elements that hold text themselves: inside an article they go by a SMALL name only.
TEXTS = HEADINGS | {"p"}
# Never left out by name, but that an article may be a reader's comment or a teaser.
WHOLE = frozenset("html body main article".split())
SMALL = COMMENTS | frozenset(
    "ad ads advert advertisement sponsored promo promoted promotion teaser related recommended widget".split()
)
# Elements of these names never stay for the text they hold.
APART = COMMENTS | frozenset(
    "respond ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "related recommended recommendations teaser notice notices cookie cookies consent gdpr disclaimer footer colophon "
    "copyright newsletter subscribe subscription".split()
)
# Words that name an element in the company of any others in a class, unless the class is a state.
ANYWHERE = COMMENTS | frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promoted "
    "notice notices cookie cookies consent gdpr newsletter signup subscribe subscription login menu submenu nav navbar "
    "navigation breadcrumb breadcrumbs pagination sidebar footer".split()
)
# Stands for a name among other words: enough to leave an element out, not to keep it from being a wrapper.
SOME_NAME = frozenset(["named"])
STATES = DENIED | frozenset("has not with without enabled disabled open closed active hidden show hide hides shows".split())
# A named element with this share of the page's dense text is a wrapper and stays.
MOST = 0.75
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SIGMA = 1.0
RADIUS = 3

_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]


class Line(NamedTuple):
    """Text of a block and where it stands."""

    text: str
    tags: int
    # Whether left out whatever the page is like; else the innermost element that leaves it out by name, or 0.
    hard: bool
    named: int
    element: int
    # The outermost article or main part around it, or 0.
    part: int
    links: bool


class Open(NamedTuple):
    """An open element."""

    tag: str
    number: int
    hard: bool
    named: int
    part: int
    # In a header of an article, which keeps its headings.
    titled: bool
    # Left out in the middle of a block: what its text interrupts goes on behind it.
    inline: bool


class _Lines(HTMLParser):
    """Collects the lines of a page and the tree of its elements, numbered in the order they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Per element its parent, the last element inside it, and the element around it that is left out by name.
        self.parent, self.last, self.around = [0], [0], [0]
        self.text: list[str] = []
        # Whether some text of the line is outside links.
        self.plain = False
        self.tags = 0
        self.open = [Open("", 0, False, 0, 0, False, False)]
        self.count: dict[str, int] = {}
        # Blocks interrupted by an excluded element inside them.
        self.interrupted: list[tuple[list[str], bool]] = []

    def _flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                at = self.open[-1]
                self.lines.append(Line(" ".join(words), self.tags, at.hard, at.named, at.number, at.part, not self.plain))
                self.tags = 0
            self.text.clear()
            self.plain = False

    def _pop(self) -> str:
        at = self.open[-1]
        if at.inline:
            self._flush()
            self.text, self.plain = self.interrupted.pop()
        elif at.tag in BLOCKS:
            self._flush()
        self.open.pop()
        self.last[at.number] = len(self.parent) - 1
        self.count[at.tag] -= 1
        return at.tag

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            # A block ends a paragraph around it, but not across a button or an object.
            if self.count.get("p") and tag != "body" and not (self.count.get("button") or self.count.get("object")):
                self._close("p")
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.open[-1].tag == tag:
                self._close(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, above, hard, named, part, titled, _ = self.open[-1]
        number = len(self.parent)
        was = hard or named
        out, names = self._is_outside(tag, attrs), self._names(tag, attrs, bool(part))
        if not out and (tag == "form" or names):
            if not APART.isdisjoint(names):
                out = True
            else:
                self.around.append(named)
                named = number
        if len(self.around) == number:
            self.around.append(0)
        if (out or named == number) and part and not was and not self._commentary(attrs) and self._is_header(tag, attrs):
            # An article's own header keeps its headings only.
            titled = True
        elif out or named == number:
            titled = False
        elif was and titled and tag in HEADINGS:
            hard, named, titled = False, 0, False
        inline = bool((out or named == number) and not was and tag not in BLOCKS)
        if inline:
            self.interrupted.append((self.text, self.plain))
            self.text, self.plain = [], False
        self.parent.append(above)
        self.last.append(number)
        part = part or (number if tag in ("article", "main") else 0)
        self.open.append(Open(tag, number, hard or out, named, part, titled, inline))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        if self.count.get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not self.count.get("a") or any(self.count.get(h) for h in HEADINGS):
            self.plain = self.plain or not data.isspace()

    @staticmethod
    def _tokens(attrs: list) -> Iterator[tuple[str, set]]:
        for name, value in attrs:
            if value and name in ("class", "id"):
                for token in value.split():
                    yield name, {word.lower() for word in NAME_WORD.findall(token)}

    def _words(self, attrs: list) -> set:
        return {word for _, words in self._tokens(attrs) for word in words}

    def _names(self, tag: str, attrs: list, article: bool) -> set:
        """The NAMES of an element: those of classes and ids that say nothing else, and some anywhere in a class.

        Of the latter, only comments count as APART; the others may turn out to be wrappers.
        """
        found: set = set()
        if not attrs or tag == "html" or tag == "body" or tag == "main":
            return found
        for name, words in self._tokens(attrs):
            names = words & NAMES
            if not names or not STATES.isdisjoint(words):
                continue
            if any(len(w) > 2 for w in words - NAMES - PARTS):
                names &= ANYWHERE
                if name == "id" or not names:
                    continue
                names = names & COMMENTS or SOME_NAME
            if name == "id" and tag in HEADINGS:
                names = set() if article else names - SUBJECTS
            elif name == "id" and article and (tag == "section" or "section" in self._words(attrs)):
                names -= SUBJECTS
            if tag == "article" or (article and tag in TEXTS):
                names &= SMALL
            found |= names
        return found

    def _commentary(self, attrs: list) -> bool:
        return not COMMENTS.isdisjoint(self._words(attrs))

    def _is_header(self, tag: str, attrs: list) -> bool:
        return tag == "header" or "header" in self._words(attrs)

    def _is_outside(self, tag: str, attrs: list) -> bool:
        out = tag in OUTSIDE
        if not out and attrs and tag not in WHOLE:
            for name, value in attrs:
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    out = True
                elif name == "role" and value in ROLES:
                    out = True
                elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    out = True
        return out

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._pop()
            self._flush()
        self.last[0] = len(self.parent) - 1
        return self.lines


def smoothed(ratios: list[float]) -> list[float]:
    """``ratios`` under a Gaussian; at the ends the kernel's weights are shared by what is there."""
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1)
        weights = _KERNEL[low - i + RADIUS : high - i + RADIUS]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def _threshold(smooth: list[float]) -> float:
    """The deviation of the smoothed ratios."""
    mean = sum(smooth) / len(smooth)
    return math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))


def _outside(page: _Lines) -> list[bool]:
    """Per line whether it is left out: by what it is in, or by a name that is not that of a wrapper."""
    lines = page.lines
    inside = [(k, len(line.text) / max(1, line.tags)) for k, line in enumerate(lines) if not line.hard]
    if not any(line.named for line in lines) or not inside:
        return [line.hard for line in lines]
    least = _threshold([r for _, r in inside])
    dense: dict[int, int] = {}
    for k, ratio in inside:
        if ratio >= least:
            dense[lines[k].named] = dense.get(lines[k].named, 0) + len(lines[k].text)
    whole = sum(dense.values())
    # Elements are numbered from the outside in, so sums go up from the last one.
    kept = {0: True}
    for element in range(len(page.parent) - 1, 0, -1):
        if element in dense:
            above = page.around[element]
            if above:
                dense[above] = dense.get(above, 0) + dense[element]
    for element in sorted({line.named for line in lines} | set(dense)):
        chain = []
        while element not in kept:
            chain.append(element)
            element = page.around[element]
        for inner in reversed(chain):
            kept[inner] = kept[page.around[inner]] and dense.get(inner, 0) >= MOST * whole
    return [line.hard or not kept[line.named] for line in lines]


def main_blocks(html: str | None) -> list[str]:
    """The lines of a page's content region."""
    if not html:
        return []
    page = _Lines()
    page.feed(html)
    lines = page.finish()
    out = _outside(page)
    marked = any(line.part and not gone for line, gone in zip(lines, out, strict=True))
    # Lines that may be content; where parts are marked, those in them.
    able = [not gone and bool(line.part or not marked) for line, gone in zip(lines, out, strict=True)]
    content = _content(lines, able)
    if not content:
        return []
    if marked:
        parts = {lines[k].part for k in content}
        return [line.text for line, ok in zip(lines, able, strict=True) if ok and line.part in parts]
    region = _widened(page, able, _around(page, content))
    held = [k for k, ok in enumerate(able) if ok and region <= lines[k].element <= page.last[region]]
    edges = [n for n, k in enumerate(held) if not lines[k].links] or [0, len(held) - 1]
    return [lines[k].text for k in held[edges[0] : edges[-1] + 1]]


def _content(lines: list[Line], able: list[bool]) -> set[int]:
    """Lines whose ratio, their own or the smoothed one, reaches the threshold, and the lines beside them."""
    ratios = [len(line.text) / max(1, line.tags) if ok else 0.0 for line, ok in zip(lines, able, strict=True)]
    if not any(ratios):
        return set()
    smooth = smoothed(ratios)
    threshold = _threshold(smooth)
    reach = {k for k, (s, r) in enumerate(zip(smooth, ratios, strict=True)) if r and max(s, r) >= threshold}
    content = {k for k in reach if not lines[k].links} or reach
    return content | _beside(lines, able, content)


def _beside(lines: list[Line], able: list[bool], content: set[int]) -> set[int]:
    """Titles, first and last words: lines near content, up to an excluded line or one of links alone."""
    found = set()
    for step in (-1, 1):
        for i in content:
            for k in range(i + step, i + step * (RADIUS + 1), step):
                if k in content or not 0 <= k < len(lines) or not able[k] or lines[k].links:
                    break
                found.add(k)
    return found


def _counted(page: _Lines, chosen: Iterable[int]) -> list[int]:
    """Per element how many of the ``chosen`` lines are in it."""
    counts = [0] * len(page.parent)
    for k in chosen:
        counts[page.lines[k].element] += 1
    for element in range(len(counts) - 1, 0, -1):
        counts[page.parent[element]] += counts[element]
    return counts


def _around(page: _Lines, content: set[int]) -> int:
    """The innermost element around all of the content."""
    counts = _counted(page, content)
    return max(element for element, count in enumerate(counts) if count == len(content))


def _widened(page: _Lines, able: list[bool], region: int) -> int:
    """A region of one line alone takes in the other lines of the element around it."""
    counts = _counted(page, [k for k, ok in enumerate(able) if ok])
    if counts[region] > 1:
        return region
    wider = region
    while wider and counts[wider] <= 1:
        wider = page.parent[wider]
    return wider if counts[wider] > 1 else region


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n\n".join(main_blocks(html.as_py())) for html in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    rows = pages.select("page_id", "url", F.col("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
