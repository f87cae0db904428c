"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams start tags, end tags and text; from these
events a page becomes lines, one for each block of text, each with its length,
the tags in it, the part of it that is link text, and the elements it stands in.
Lines in elements that are no article by their kind, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, comments, ...) count as
having no text.

A line's ratio is its text outside links over its tags. Ratios are smoothed with
a Gaussian over neighbouring lines, and two clusters of the smoothed logarithms
set the threshold between content and the rest. The content region is the
deepest element that holds most of the text above the threshold, an article or
main element before others. All its lines are the text, short ones too, but for
those left out by their element and for runs of links mostly below the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import text_or_empty

#: Standard deviation of the smoothing, in lines; share of the text above the threshold that the content region holds.
SIGMA, MOST = 1.0, 0.7
#: A line is a run of links from this share of link text on.
LINKED = 0.9

# Fixed values of HTML: elements without end tags, elements that begin a line, and elements whose text is never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section
summary table tbody td tfoot th thead title tr ul""".split())
UNSEEN = frozenset("head script style noscript template iframe object svg canvas audio video select button textarea datalist map".split())
ASIDE = frozenset("nav footer aside form dialog menu search header".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An open element of the first kind ends where one of the second starts.
CLOSES = {"p": BLOCK - {"option", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
          "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar
tablist""".split())
# Words of class and id names that mark what is no article.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion
promoted banner nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer sidebar aside sidenav cookie cookies
consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin login paywall share sharing
social comment comments commentlist disqus replies reply respond related recommended recommendations trending widget widgets toolbar
skip masthead topbar copyright disclaimer search form""".split())
HEADS = frozenset(("header", "head"))
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is no article by its role, class, id, or as it is hidden."""
    if tag in ("html", "body", *ROOTS) and not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return tag not in ("html", "body")
        if not value or tag in ("html", "body"):
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in WORDS.findall(part)]
                if any(w in MARKS for w in words) or (len(words) == 1 and words[0] in HEADS):
                    return True
    return False


class _Element:
    __slots__ = ("tag", "parent", "depth", "skip", "unseen", "root")

    def __init__(self, tag: str, parent: "_Element | None", skip: bool, unseen: bool):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.skip, self.unseen = skip, unseen
        self.root = tag in ROOTS and not skip


class Line:
    """A block's text, tags, characters in links, and the element it stands in."""

    __slots__ = ("text", "tags", "linked", "element", "skip")

    def __init__(self, text: str, tags: int, linked: int, element: _Element, skip: bool):
        self.text, self.tags, self.linked, self.element, self.skip = text, tags, linked, element, skip

    @property
    def ratio(self) -> float:
        return 0.0 if self.skip else max(0, len(self.text) - self.linked) / max(1, self.tags)


class LineReader(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Element("", None, False, False)]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0
        self.named: Counter[str] = Counter()

    def updatepos(self, i: int, j: int) -> int:
        return j                               # line numbers aren't needed

    def parse_html_declaration(self, i: int) -> int:
        # a section that no HTML page has (<![...) is a comment, not an error
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            here = self.open[-1]
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), here, here.skip))
        self.parts, self.tags, self.linked = [], 0, 0

    def _close(self, at: int) -> None:
        """End the open elements from place ``at`` on."""
        if any(e.tag in BLOCK for e in self.open[at:]):
            self.end_line()
        self.links -= sum(e.tag == "a" for e in self.open[at:])
        self.named.subtract(e.tag for e in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # what this tag ends without saying so
        for i in range(len(self.open) - 1, 0, -1):
            was = self.open[i].tag
            if tag in CLOSES.get(was, ()):
                self._close(i)
                break
            if was in BLOCK and (was in SCOPES.get(tag, ()) or tag not in SCOPES):
                break
        if tag in ROOTS:                       # an article is not part of a menu or form that was left open
            for i in range(1, len(self.open)):
                if self.open[i].tag in ("nav", "header", "footer", "form", "head", "p", "ul") and not self.open[i].parent.skip:
                    self._close(i)
                    break
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            self.parts.append(" ")
            return
        here = self.open[-1]
        # the heading of an article may stand in a header of its own
        own_header = tag == "header" and any(self.named[r] for r in ROOTS)
        skip = here.skip or (tag in ASIDE and not own_header) or is_marked(tag, attrs)
        self.open.append(_Element(tag, here, skip, here.unseen or tag in UNSEEN))
        self.named[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)       # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID or not self.named[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in ROOTS and tag in ("p", "li", "a", "b", "i", "span", "em", "strong"):
                return                          # a stray end tag does not end the article

    def handle_data(self, data: str) -> None:
        if not self.open[-1].unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines, less of them at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    whole = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters (means) of the values, started at their least and largest."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if upper.all() or not upper.any():
            return cut if upper.any() else low - 1.0
        now = float(values[~upper].mean()), float(values[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def content_lines(lines: list[Line]) -> list[str]:
    shown = [line for line in lines if not line.skip]
    if not shown:
        return []
    value = np.log1p(smoothed(np.array([line.ratio for line in lines])))
    content = {id(line) for line, high in zip(lines, value > threshold(value)) if high and not line.skip}
    chosen = [line for line in shown if id(line) in content] or shown
    mass: dict[int, int] = {}
    elements: dict[int, _Element] = {}
    for line in chosen:
        mass[id(line.element)] = mass.get(id(line.element), 0) + len(line.text) - line.linked + 1
        element: _Element | None = line.element
        while element is not None and id(element) not in elements:
            elements[id(element)] = element
            element = element.parent
    for element in sorted(elements.values(), key=lambda e: -e.depth):       # from the leaves up
        if element.parent is not None:
            mass[id(element.parent)] = mass.get(id(element.parent), 0) + mass[id(element)]
    total = max(mass.values())
    roots = [e for i, e in elements.items() if e.root and mass[i] >= (1 - MOST) * total]
    if roots:
        # the outermost articles: a page may have several
        region = {id(e) for e in roots}
    else:
        deep = max((e for i, e in elements.items() if mass[i] >= MOST * total and not _is_line(e)), key=lambda e: e.depth)
        region = {id(deep)}
    inside = {i: True for i in region}
    out: list[str] = []
    run: list[Line] = []

    def end_run() -> None:
        """A run of lines that are links is no text if most of it is below the threshold."""
        if 2 * sum(id(line) in content for line in run) >= len(run):
            out.extend(line.text for line in run)
        run.clear()

    for line in shown:
        path, element = [], line.element
        while element is not None and id(element) not in inside:
            path.append(id(element))
            element = element.parent
        within = element is not None and inside[id(element)]
        inside.update(dict.fromkeys(path, within))
        if not within:
            continue
        if line.linked and line.linked >= LINKED * len("".join(line.text.split())):
            run.append(line)
        else:
            end_run()
            out.append(line.text)
    end_run()
    return out


def _is_line(element: _Element) -> bool:
    """Elements that hold a single line rather than a region."""
    return element.tag in ("p", "li", "td", "th", "dt", "dd", "tr", "ul", "ol", "blockquote", "pre") or element.tag in HEADINGS \
        or element.tag not in BLOCK and element.tag != ""


def main_text(html: str) -> str:
    """The main text of a page, a block a line; empty if it has none."""
    reader = LineReader()
    reader.feed(html)
    return "\n".join(content_lines(reader.finish()))


def extract_text(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` (code points) for each row, whole pages of any length.

    A null or empty page, and one without an article, has an empty text. Of regions
    with equal text the deepest, then the first is taken. Repeated rows are each
    returned; ids and urls may be null. An empty table gives no rows.
    """
    slim = df.select(df[id_col].alias("id"), df[url].alias("url"), text_or_empty(df, html).alias("html"))
    kinds = [f.dataType.simpleString() for f in slim.schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url, "text", "n_chars"])

    return slim.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
