"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into
lines, and each line has a ratio of text to tags (link text counts as none).
A Gaussian smooths the ratios along the page, on a scale of logarithms, and a
threshold between two cluster centres marks the lines of the content region:
they, and what lies between them, are the text.  At its two ends the region
takes in what stands in the same part of the page (a short title or lead before
the first marked line, a short end after the last): the innermost element that
holds nearly all marked text, grown while what its parents add is not mostly
links.

What a line stands in only lowers its ratio.  In menus, headers, footers,
asides, forms and what is hidden, and under a class, id or role that is the name
of a menu, advert, sidebar, notice or of readers' comments, it is zero; beside
the article or main element that holds the page's text, and (outside of such an
element) under names that merely hint at these things, it is a tenth.  A lowered
line gets no help from its neighbours: it belongs to the text only if its own
lowered ratio reaches the threshold, so never if that is zero.

The article or main element is the one with most text of its own (links, and
parts that are themselves lowered to zero, don't count), if that is more than
half of what the page says outside of such parts: comments, banners and adverts
may be longer than it.  What it stands in (a form around the whole page, a
wrapper of an odd name) lowers nothing.  On a page without one, a form, fieldset,
dialog or odd name around nine tenths of the text lowers nothing either, and a
short last part in an element of its own, like an unnamed footer, is left out
unless its own ratio reaches the threshold.

White space inside a block becomes one space, blocks are joined by two line
ends, nothing else is dropped or cut.  Null and empty pages give an empty text;
broken markup is read as far as the parser gets, unclosed elements end with
their parents.  Time grows in proportion to the page, however long or deep.
Repeated rows and rows with a null id are each extracted; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package

# Element names of the HTML standard, by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style template noscript title head iframe object canvas audio video textarea select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
HOLDERS = frozenset("article main".split())
WRAPPERS = frozenset("form fieldset dialog".split())
CONTAINERS = frozenset("div section center table tr td".split())
# A class, id or role that is wholly one of these names something beside the article.
_REGION = re.compile(
    r"(?:ads?|advert\w*|ad[-_](?:slot|box|banner|unit|container|wrapper)|sponsor(?:ed)?|promo(?:tion)?s?|nav|nav[-_]?bar|navigation|menu|[a-z]+[-_](?:nav|menu)|breadcrumbs?|"
    r"side[-_]?bar(?:[-_]\w+)?|(?:left|right|page|site)[-_]?side(?:[-_]?bar)?|(?:page|site|global)[-_]?(?:header|footer)|footer|masthead|banner|cookies?|(?:cookie|consent|privacy)[-_](?:notice|banner|bar|consent|box)|"
    r"notices?|popup|modal|newsletter(?:[-_]\w+)?|subscribe|subscription|sign[-_]?up|log[-_]?in|search(?:[-_]?(?:form|box|bar))?|share|sharing|social(?:[-_]\w+)?|"
    r"related(?:[-_](?:posts|articles|links|stories|content|items))?|recommend(?:ed|ations)|(?:reader|user)?[-_]?comments?(?:[-_]?(?:list|section|area|thread|box|form|item|body|text|wrapper))?|"
    r"disqus(?:[-_]thread)?|replies|pagination|pager|widgets?|copyright|toolbar|complementary|contentinfo)"
)
# A name that holds one of these words hints at such a thing.
_HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|side|footer\w*|header|masthead|breadcrumbs?|cookies?|consent|notices?|popup|"
    r"modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|replies|pagination|pager|widget\w*|copyright|legal|toolbar)(?:$|[^a-z])"
)
# Names that no wrapper of a whole page has.
_NEVER_WRAPS = re.compile(r"(?:ads?|advert\w*|ad[-_]\w+|sponsor\w*|cookies?|(?:cookie|consent|privacy)[-_]\w+|.*comments?.*|disqus.*|replies|newsletter.*|related.*|recommend.*)")
# How a page's last line begins that only says whose it is.
_OWNED = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos)", re.IGNORECASE)
SHORT = 200
_HEADING = re.compile(r"h[1-6]")
# Such a word says what a wrapper has or lacks ("with-sidebar", "no-nav"), not what it is.
_ABOUT_OTHERS = re.compile(r"(?<![a-z])(?:with|without|has|no)[-_]+\S*")
LOWERED = 0.1
_SPACE = re.compile(r"\s+")
# An open paragraph (or item, row, cell, page head) ends where one of these starts.
_ENDED_BY = {
    "p": BLOCKS, "head": BLOCKS - {"html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}


class _Element:
    __slots__ = ("name", "parent", "place", "bar", "tucked", "hidden", "inside", "share", "odd", "size", "clean", "factor")

    def __init__(self, name: str, parent: "_Element | None", place: int, bar: bool, tucked: bool, hidden: bool, share: float, odd: bool):
        self.name, self.parent, self.place, self.hidden = name, parent, place, hidden
        # ``bar``: lowers to zero what is in it; ``tucked``: marked as not shown; ``share``: what its own names leave of a ratio;
        # ``odd``: these names may stand on a wrapper; ``inside``: in an article or main element.
        self.bar, self.tucked, self.share, self.odd = bar, tucked, share, odd
        self.inside = name in HOLDERS or parent is not None and parent.inside
        self.size = self.clean = 0  # all text below, and that without links, outside of parts lowered to zero
        self.factor = 1.0

    @property
    def apart(self) -> bool:
        return self.bar or self.tucked or self.share == 0.0


class PageLines(HTMLParser):
    """Cuts a page into lines: (text, length of link text, number of tags, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, _Element]] = []
        self.elements = [_Element("", None, 0, False, False, False, 1.0, True)]  # parents stand before their children
        self._open = self.elements[0]
        self._names: dict[str, int] = {}  # how many open elements have a name
        self._regions: list[dict[str, int]] = [{}]  # the same since each open region began
        self._parts: list[str] = []
        self._tags = self._linked = self._in_link = 0

    def _break(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.lines.append((text, self._linked, self._tags, self._open))
            self._parts = []
        self._tags = self._linked = 0

    def _leave(self) -> None:
        """Close the innermost open element."""
        name = self._open.name
        self._names[name] -= 1
        self._regions[-1][name] -= 1
        if name in OUTSIDE or name in HOLDERS:
            self._regions.pop()
        self._open = self._open.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append("\n")
            return
        if tag in BLOCKS:
            self._break()
        if tag in VOID:
            return
        if tag == "a":
            self._in_link += 1
        while tag in _ENDED_BY.get(self._open.name, ()):
            self._leave()
        up = self._open
        # An article's own header belongs to it; a page's header does not.
        bar = tag in OUTSIDE and not (tag == "header" and up.inside)
        tucked = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        named = [v.lower() for k, v in attrs if v and k in ("class", "id", "role")]
        share, odd = 1.0, True
        if named and tag not in ("main", "html", "body"):
            names = _ABOUT_OTHERS.sub(" ", " ".join(named)).split()
            odd = not any(_NEVER_WRAPS.fullmatch(n) for n in names)
            if any(_REGION.fullmatch(n) for n in names):
                share = 0.0
            elif not up.inside and tag not in HOLDERS and any(_HINT.search(n) for n in names):
                share = LOWERED
        self._open = _Element(tag, up, len(self.elements), bar, tucked, up.hidden or tag in HIDDEN, share, odd)
        self.elements.append(self._open)
        self._names[tag] = self._names.get(tag, 0) + 1
        if tag in OUTSIDE or tag in HOLDERS:
            self._regions.append({})
        self._regions[-1][tag] = self._regions[-1].get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append("\n")
            return
        if tag in BLOCKS:
            self._break()
        if tag == "a" and self._in_link:
            self._in_link -= 1
        # A stray end tag closes nothing; an inline one doesn't close the region around it.
        if self._regions[-1].get(tag) or tag in BLOCKS and self._names.get(tag):
            while self._open.name != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        if not self._open.hidden:
            self._parts.append(data)
            if self._in_link:
                self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._break()
        self._weigh()

    def _weigh(self) -> None:
        """What each element leaves of the ratios of its lines."""
        for text, linked, _, e in self.lines:
            e.size += len(text)
            e.clean += max(0, len(text) - linked)
        for e in reversed(self.elements):
            if e.parent is not None:
                e.parent.size += e.size
                if not e.apart:
                    e.parent.clean += e.clean
        total = self.elements[0].size
        self.holder = holder = self._find_holder(total)
        above = set()
        at = holder
        while at is not None:
            above.add(at)
            at = at.parent
        for e in self.elements:
            e.factor = 1.0 if e.parent is None or e is holder else e.parent.factor
            if e in above:
                continue
            wraps = holder is None and 10 * e.size >= 9 * total
            if e.tucked or e.bar and not (wraps and e.name in WRAPPERS):
                e.factor = 0.0
            elif not (wraps and e.odd):
                e.factor *= e.share
        if holder is not None:
            inner = [False] * len(self.elements)
            for e in self.elements:
                inner[e.place] = e is holder or e.parent is not None and inner[e.parent.place]
                if not inner[e.place]:
                    e.factor *= LOWERED

    def _find_holder(self, total: int) -> _Element | None:
        """The article or main element that holds the page's text, if there is one."""
        rest = self.elements[0].clean  # what the page says outside of parts lowered to zero
        apart, closed = [False] * len(self.elements), [False] * len(self.elements)
        free = caught = None
        for e in self.elements[1:]:
            # Below such a part; and below one that can't be a mere wrapper.
            apart[e.place] = apart[e.parent.place] or e.apart
            wrapper = e.name in WRAPPERS if e.bar else e.odd and 10 * e.size >= 9 * total
            closed[e.place] = closed[e.parent.place] or e.tucked or (e.bar or e.share == 0.0) and not wrapper
            if e.name in HOLDERS and e.clean and not closed[e.place]:
                if not apart[e.place]:
                    free = e if free is None or e.clean > free.clean else free
                else:
                    caught = e if caught is None or e.clean > caught.clean else caught
        if free is not None and 2 * free.clean > rest:
            return free
        return caught if caught is not None and caught.clean > rest else None


def _ratios(lines: list[tuple[str, int, int, _Element]], spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Each line's own ratio and its smoothed one, on a scale of logarithms."""
    factors = np.array([e.factor for _, _, _, e in lines])
    own = np.log1p(np.array([max(0, len(text) - linked) / max(1, tags) for text, linked, tags, _ in lines]) * factors)
    reach = max(1, int(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    smooth = np.convolve(own, kernel, "same") / np.convolve(np.ones(len(own)), kernel, "same") if len(own) > 2 * reach else own
    return own, np.where(factors < 1.0, np.minimum(own, smooth), smooth)


def _threshold(ratios: np.ndarray) -> float | None:
    """Half way between two cluster centres on a line; none if all ratios are the same."""
    low, high = ratios.min(), ratios.max()
    for _ in range(20):
        split = (low + high) / 2
        above, below = ratios[ratios > split], ratios[ratios <= split]
        new = (below.mean() if len(below) else low, above.mean() if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > low else None


def content_lines(lines: list[tuple[str, int, int, _Element]], spread: float = 1.0) -> np.ndarray:
    """Which lines lie in the content region, by smoothed text-to-tag ratios."""
    _, ratios = _ratios(lines, spread)
    split = _threshold(ratios)
    return (ratios >= split if split is not None else ratios > 0) & np.array([e.factor > 0 for _, _, _, e in lines])


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by two line ends."""
    if not html:
        return ""
    parser = PageLines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not any(e.factor for _, _, _, e in lines):
        return ""
    marked = content_lines(lines)
    if not marked.any():
        return ""
    first, last = int(np.argmax(marked)), len(lines) - 1 - int(np.argmax(marked[::-1]))
    inside, beside, hangs = _holder(parser, marked)
    # A whole line is in by standing between marked ones, or in the same part of the page; a lowered one by its own ratio.
    # Beside the part that holds the marked lines, a line that is all link says nothing unless it is a heading.
    kept = [
        bool(marked[k] or e.factor == 1.0 and (first < k < last or inside[e.place] and (not beside[e.place] or linked < len(text) or _HEADING.fullmatch(e.name))))
        for k, (text, linked, _, e) in enumerate(lines)
    ]
    if parser.holder is None:
        _drop_end(parser, kept, hangs)
    return "\n\n".join(text for (text, _, _, _), k in zip(lines, kept) if k)


def _drop_end(parser: PageLines, kept: list[bool], hangs: list[int]) -> None:
    """Unmark a short last part that stands in an element of its own, or says whose the page is."""
    lines = parser.lines
    own, ratios = _ratios(lines, 1.0)
    split = _threshold(ratios)
    strong = [split is None or o >= split for o in own]
    # Where the paragraphs themselves are such elements, a short last one is like the others.
    bodies = {hangs[e.place] for (_, _, _, e), s, k in zip(lines, strong, kept) if s and k and parser.elements[hangs[e.place]].name in CONTAINERS}
    for k in range(len(lines) - 1, 0, -1):
        text, _, _, e = lines[k]
        if not kept[k]:
            continue
        alone = not strong[k] and len(bodies) < 2 and hangs[e.place] not in bodies and parser.elements[hangs[e.place]].name in CONTAINERS
        if len(text) > SHORT or not (alone or _OWNED.match(text)) or not any(kept[:k]):
            break
        kept[k] = False


def _holder(parser: PageLines, marked: np.ndarray) -> tuple[list[bool], list[bool], list[int]]:
    """For each element, whether it lies in the part of the page that holds the marked lines, whether beside the innermost one, and below which child of the elements around these."""
    elements, votes = parser.elements, [0] * len(parser.elements)
    for (text, _, _, e), m in zip(parser.lines, marked):
        if m:
            votes[e.place] += len(text)
    for e in reversed(elements):
        if e.parent is not None:
            votes[e.parent.place] += votes[e.place]
    # Going down while one child holds nearly all of the marked text; items and paragraphs are no parts.
    holder = elements[0]
    for e in elements:
        if e.parent is holder and 10 * votes[e.place] >= 9 * votes[0] and e.name not in _ENDED_BY:
            holder = e
    chain, at = [], holder
    while at is not None:
        chain.append(at)
        at = at.parent
    # The level of the chain at which each element hangs, and what each level adds to the one below.
    level = [len(chain)] * len(elements)
    for k, e in enumerate(chain):
        level[e.place] = k
    known = {e.place for e in chain}
    hangs = list(range(len(elements)))
    for e in elements:
        if e.place not in known:
            level[e.place] = level[e.parent.place]
            if e.parent.place not in known:
                hangs[e.place] = hangs[e.parent.place]
    added, linked = [0] * len(chain), [0] * len(chain)
    for text, links, _, e in parser.lines:
        if e.factor == 1.0:
            added[level[e.place]] += len(text)
            linked[level[e.place]] += links
    top = 0
    while top + 1 < len(chain) and 2 * linked[top + 1] <= added[top + 1]:
        top += 1
    bare = holder.name in ("", "html", "body")  # paragraphs beside menus, without a part of their own
    return [k <= top for k in level], [k > 0 or bare for k in level], hangs


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, ``text``, ``n_chars``."""
    ship_package(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(work, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
