"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams tags and text; each block of running
text is a line, with the elements it stands in and the tags that were met around
it. The lines' ratios of text to tags are smoothed with a Gaussian, and lines
above a threshold cluster into content. The content container is the smallest
element that holds the clustered text, or the outermost article and main
elements; all of its lines are kept, so no heading or short paragraph is lost.
Parts marked as menus, notices, adverts and the like are left out, unless the
marked element is what the content stands in. Ids mark containers only, and where
a word of an article may as well name its subject ("related-work"), the mark holds
only if much of the part's text is links.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select textarea option dialog svg canvas "
    "iframe object audio video math menu".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_REGION = frozenset(("article", "main"))
#: Elements that hold blocks; others (paragraphs, headings, cells) are no containers.
_CONTAINERS = frozenset("div section article main center td".split())
#: Lines of these that stand next to the content of a page without a container belong to it.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments "
    "disqus respond share sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay widget toolbar pagination pager copyright legal skip".split())
#: Of these, words that also name subjects: as a part of a name, or on a paragraph or heading, they do not decide alone.
_AMBIGUOUS = frozenset("alert banner copyright legal login menu notice promotion related share sharing skip social toolbar widget".split())
#: Share of link text from which such a mark holds.
_LINKED = 0.3
_MARKED_OUTSIDE = frozenset(("header", "masthead", "topbar", "logo"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"))
_TOKENS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Line:
    text: str
    tags: int
    element: int
    linked: int = 0


@dataclass
class Element:
    """``mark``: 0 for none, 1 for a dashed part of a class or id, 2 for a whole one; ``soft`` if links have to confirm
    it. ``region``: the outermost
    article or main element that it stands in or is, 0 for none."""

    tag: str
    parent: int
    mark: int = 0
    region: int = 0
    soft: bool = False


class _Lines(HTMLParser):
    """Collects the lines of a page and its block elements; element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element("", -1)]
        self.open: list[tuple[str, bool, int]] = []  # tag, left out, element
        self.blocks: list[int] = []  # places in ``open`` of what is not inline
        self.places: dict[str, list[int]] = {}  # places in ``open`` by tag
        self.linked = 0
        self.parts: list[str] = []
        self.tags = 0

    def _state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self._state()[1], self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self.flush()
        for tag, *_ in self.open[at:]:
            self.places[tag].pop()
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def _leave_out(self, tag: str, attrs: dict, region: int) -> bool:
        if tag in _NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if tag == "header" and not region:
            return True
        if (attrs.get("role") or "").lower() in _ROLES or _HIDDEN.search((attrs.get("style") or "").lower()):
            return True
        return False

    def _mark(self, tag: str, attrs: dict, region: int) -> tuple[int, bool]:
        """The mark, and whether it is soft."""
        if tag in ("html", "body", "main"):
            return 0, False
        named = (attrs.get("class") or "").lower()
        if tag not in _INLINE and tag not in _RUNNING:
            named += f" {attrs.get('id') or ''}".lower()
        marks = _MARKED if region else _MARKED | _MARKED_OUTSIDE
        found = marks.intersection(_TOKENS.findall(named))
        if not found:
            return 0, False
        mark = 1 if marks.isdisjoint(named.split()) else 2
        return mark, region > 0 and found <= _AMBIGUOUS and (mark == 1 or tag in _RUNNING)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br" or tag == "hr":
            self.flush() if tag == "hr" else self.parts.append(" ")
            return
        if tag in _VOID:
            return
        ends = {"p"} if tag in _ENDS_P else _SAME_ENDS.get(tag, ())
        if self.blocks and self.open[self.blocks[-1]][0] in ends:
            self._pop(self.blocks[-1])
        if tag not in _INLINE:
            self.flush()
        out, element = self._state()
        region, mark, soft = self.elements[element].region, 0, False
        if attrs or tag in _NEVER or tag == "header":
            out = out or self._leave_out(tag, dict(attrs), region)
            mark, soft = self._mark(tag, dict(attrs), region)
        if tag in _INLINE:
            out = out or (mark > 0 and not soft)
        else:
            self.blocks.append(len(self.open))
            self.elements.append(Element(tag, element, mark, region, soft))
            element = len(self.elements) - 1
            if not region and (tag in _REGION or ("role", "main") in attrs):
                self.elements[element].region = element
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, out, element))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.places.get(tag)
        if places and not (tag in _INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self._pop(places[-1])

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over three deviations to each side; the ends are weighted by what is there."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weights


def _content(lines: list[Line], sigma: float, strength: float) -> np.ndarray:
    """Which lines have a smoothed ratio of at least ``strength`` of the mean smoothed ratio, weighted by text."""
    size = np.array([len(line.text) for line in lines], np.float64)
    smooth = smoothed(size / np.array([max(1, line.tags) for line in lines]), sigma)
    return smooth >= strength * float((smooth * size).sum() / size.sum())


def _confirm_marks(lines: list[Line], elements: list[Element]) -> None:
    """Soft marks stay where links hold ``_LINKED`` of the element's text."""
    if not any(e.soft for e in elements):
        return
    text, linked = [0] * len(elements), [0] * len(elements)
    for line in lines:
        text[line.element] += len(line.text)
        linked[line.element] += line.linked
    for k in range(len(elements) - 1, 0, -1):  # a parent comes before its children
        text[elements[k].parent] += text[k]
        linked[elements[k].parent] += linked[k]
        if elements[k].soft and linked[k] < _LINKED * text[k]:
            elements[k].mark = 0


def _unmarked(lines: list[Line], elements: list[Element], content: np.ndarray) -> list[Line]:
    """The lines outside of marked elements. The mark of an element that the content stands in does not count:
    one that holds more of the content, without its own marked parts, than the page outside of it; if a
    whole class or id marks it and it holds no region, then only if there is no other content."""
    marked = {k for k, e in enumerate(elements) if e.mark}
    regional = {e.parent for k, e in enumerate(elements) if k and e.region == k}
    for k in range(len(elements) - 1, 0, -1):
        if k in regional:
            regional.add(elements[k].parent)
    while marked:
        above: list[int] = [0] * len(elements)  # the innermost marked element that each element stands in or is
        for k in range(1, len(elements)):
            above[k] = k if k in marked else above[elements[k].parent]
        held = Counter()
        for line, good in zip(lines, content):
            if good:
                held[above[line.element]] += len(line.text)
        void = [k for k, n in held.items() if k and n > held[0]
                and (elements[k].mark == 1 or k in regional or not held[0])]
        if not void:
            break
        best = max(void, key=lambda k: (held[k], -k))
        while best > 0:  # what stands around it is no side part either
            marked.discard(best)
            best = elements[best].parent
    else:
        above = [0] * len(elements)
    kept, tags = [], 0
    for line in lines:
        tags += line.tags
        if not above[line.element]:
            kept.append(Line(line.text, tags, line.element, line.linked))
            tags = 0
    return kept


def _container(content: np.ndarray, elements: list[Element], lines: list[Line]) -> int:
    """The smallest element that holds all content and more than one line; 0 for the page."""
    held, holds = [0] * len(elements), [0] * len(elements)
    for line, good in zip(lines, content):
        held[line.element] += int(good)
        holds[line.element] += 1
    for k in range(len(elements) - 1, 0, -1):  # a parent comes before its children
        held[elements[k].parent] += held[k]
        holds[elements[k].parent] += holds[k]
    return max((k for k, e in enumerate(elements) if e.tag in _CONTAINERS and held[k] == held[0] and holds[k] > 1), default=0)


def main_text(html: str | None, sigma: float = 1.0, strength: float = 0.5) -> str:
    """The content blocks of a page in order, joined by one space. Null, empty and textless pages give ''.

    A line is content if its smoothed ratio is at least ``strength`` of the
    page's mean smoothed ratio, weighted by text. If most of that text stands in
    article or main elements, all lines of those are the result; else all lines of the
    smallest element that holds it. Where that is the page itself, the lines
    from the first content to the last, with the parts of the page that hold
    these and headings and paragraphs next to them.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines, elements = parser.lines, parser.elements
    if not lines:
        return ""
    _confirm_marks(lines, elements)
    lines = _unmarked(lines, elements, _content(lines, sigma, strength))
    if not lines:
        return ""
    content = _content(lines, sigma, strength)
    held = Counter()
    for line, good in zip(lines, content):
        if good:
            held[elements[line.element].region > 0] += len(line.text)
    if held[True] >= held[False]:
        return " ".join(line.text for line in lines if elements[line.element].region)
    found = np.flatnonzero(content).tolist()
    whole = _container(content, elements, lines)
    inside = [False] * len(elements)
    tops = [0] * len(elements)
    for k in range(1, len(elements)):
        parent = elements[k].parent
        inside[k] = k == whole or inside[parent]
        tops[k] = tops[parent] or (0 if elements[k].tag in ("html", "body") else k)
    if whole:
        return " ".join(line.text for line in lines if inside[line.element])
    parts = {tops[lines[k].element] for k in found} - {0}
    own = [k for k, line in enumerate(lines) if content[k] or tops[line.element] in parts]
    first, last = own[0], own[-1]
    while first and elements[lines[first - 1].element].tag in _RUNNING:
        first -= 1
    while last + 1 < len(lines) and elements[lines[last + 1].element].tag in _RUNNING:
        last += 1
    return " ".join(line.text for line in lines[first:last + 1])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page; rows and other columns stay (a column named ``out`` is replaced)."""
    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    return pages.withColumn(out, texts(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
