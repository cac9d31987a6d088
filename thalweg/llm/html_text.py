"""Main text of web pages by the distribution of text over lines.

Markup is stripped and each block (paragraph, heading, list item, cell...) becomes a
line; where a container begins or ends, empty lines stand, and so does everything that
is no article by its element (menus, headers, footers, sidebars, forms), or by a class,
id or role that as a whole names such a thing, notices, adverts or comments; a label is not
believed of what holds more than half of the text, and the headings of an article's own
header stay. The text lengths, less those of links, are summed over sliding windows of lines. A
stretch begins at the surge where a window's sum rises from nothing and ends at the dive
where it falls back to nothing. The stretch of the densest window (from the first heading of
the first level on, where there is one) stays, and those after it, unless they are mostly links; of those before it, the ones from the title on (the
first of the highest headings), or, without headings, those with a window of at least SURGE
characters. Other stretches of nothing but notes of copyright go. Where a page marks its
article or main part, all lines inside stay and no others.

Defined results: null or empty html gives an empty text; a page that is all menus gives
an empty text; unclosed elements end with the page, with an element around them, or,
those that are no article, where an article begins; pages are handled each on its own,
whatever their ids.
"""

from __future__ import annotations

import functools
import html as _html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: Empty lines at the border of a container: a window among them sums to nothing.
GAP = WINDOW

# Elements by what they are for.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button")
NOT_ARTICLE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "head")
CONTAINERS = ("html", "body", "main", "article", "section", "div", "table", "ul", "ol", "dl", "center", "td")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "caption", "pre", "blockquote", "figure", "figcaption", "address", "hr", "fieldset", "legend", "details", "summary", "option")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Words of a class, id or role that name what is no article.
LABELS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner billboard "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar footer contentinfo colophon copyright "
    "sidebar aside complementary widget widgets rail related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay dialog newsletter subscribe subscription signup login paywall "
    "comment comments commentlist respond reply replies disqus share sharing social form hidden"
).split()

#: Words beside those in a label that do not change what it names.
PLAIN = (
    "container wrapper wrap box block section area region list item items inner outer top bottom left right center main primary secondary site page global "
    "content body post posts entry article articles link links slot unit row col column panel module bar text title heading icon button buttons first last fixed sticky mobile desktop js the alert discussion follow search"
).split()

_CLOSING = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)
_BORDERS = frozenset(("body", "section", "div", "table", "ul", "ol", "dl", "figure", "blockquote"))
#: Elements whose end may be left out.
_SHUT = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "hr", "h1", "h2", "h3", "h4", "h5", "h6"))
#: Which of them end where others begin (a paragraph ends at any block).
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "option": ("option",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_NAMES = re.compile(r"[a-z]+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_RAW, _NOT, _CONTAINERS, _BLOCKS, _VOID, _LABELS, _PLAIN = map(frozenset, (RAW, NOT_ARTICLE, CONTAINERS, BLOCKS, VOID, LABELS, PLAIN))


@functools.lru_cache(4096)
def _is_label(token: str) -> bool:
    """Whether a class's words are labels, but for words that say nothing."""
    words = set(_NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
    return not words.isdisjoint(_LABELS) and words <= _LABELS | _PLAIN


def labelled_out(attributes: str) -> bool:
    """Whether a class, id or role as a whole names what is no article, or the element is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if any(_is_label(token) for value in _LABEL.findall(attributes) for token in value.strip("\"'").split()):
        return True
    return bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"", lambda m: m[0] if "display" in m[0] else "", attributes)))


class Line(NamedTuple):
    text: str
    #: Characters outside links.
    plain: int = 0
    article: bool = False
    #: 1 to 6 in a heading.
    heading: int = 0
    #: Numbers of the elements around it that are no article.
    outside: tuple[int, ...] = ()


GAP_LINE = Line("")


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """(lines, empty ones being gaps; the numbers of elements that only a label calls no article)."""
    lines: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, with their number if they are no article
    labels: set[int] = set()
    at, link, article, heading, headed, number = 0, 0, 0, 0, 0, 0
    hung = 0  # labelled elements whose end may be left out
    outside: tuple[int, ...] = ()

    def end(gap: int = 0) -> None:
        nonlocal headed
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        if text:
            bare = len(text) - len(" ".join(_html.unescape("".join(linked)).split())) if linked else len(text)
            lines.append(Line(text, max(0, bare), article > 0, headed, outside))
        parts.clear()
        linked.clear()
        headed = heading
        lines.extend([GAP_LINE] * gap)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside an element whose text is no markup
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in _RAW and not closing and not attributes.rstrip().endswith("/"):
            close = _ENDS[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID and name != "hr":
            continue
        whole, border = name in ("article", "main"), name in _BORDERS
        if name in _BLOCKS or name in _CONTAINERS or name in _NOT:
            end(GAP if whole or border and not article else 0)
            while hung and not closing and stack and (stack[-1][0] == "p" or name in _ENDED_BY.get(stack[-1][0], ())):
                gone = stack.pop()[1]  # ended by what begins here
                if gone:
                    outside, hung = tuple(n for n in outside if n != gone), hung - 1
        if name[0] == "h" and name[1:].isdigit():
            heading = headed = 0 if closing else int(name[1:])
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    gone = {n for _, n in stack[k:] if n}
                    if gone:
                        end(0 if article else GAP)
                        outside = tuple(n for n in outside if n not in gone)
                    article -= sum(x in ("article", "main") for x, _ in stack[k:])
                    hung -= sum(n > 0 and x in _SHUT for x, n in stack[k:])
                    del stack[k:]
                    break
            continue
        mine = 0
        labelled = name not in ("html", "body", "main", "hr") and labelled_out(attributes)
        if name in _SHUT and not labelled and (not hung or name == "hr"):
            continue  # needs no end, and nothing hangs on it
        hung += labelled and name in _SHUT
        if whole and not labelled and outside and not outside[-1] in labels and stack and not article:
            # what was left open ends where an article begins
            stack, outside, hung = [(x, 0) for x, n in stack if not n], (), 0
        if name in _NOT and not (name == "header" and article) or labelled:
            end(0 if article else GAP)
            number += 1
            mine, outside = number, (*outside, number)
            if name not in _NOT:
                labels.add(number)
        elif name == "header":  # an article's own: its headings stay
            end()
            number += 1
            mine, outside = -number, (*outside, -number)
        if whole:
            article += 1
        stack.append((name, mine))
    if at < len(page):
        parts.append(page[at:])
    end()
    return lines, labels


def inside_lines(lines: list[Line], labels: set[int]) -> list[Line]:
    """The lines less those that are no article by an element, or a label of one that holds less than half of the text."""
    total = sum(x.plain for x in lines)
    held = {n: 0 for n in labels}
    for x in lines:
        for n in x.outside:
            if n in held:
                held[n] += x.plain
    kept = {n for n, size in held.items() if 2 * size > total}

    def stays(x: Line) -> bool:
        return not x.outside or all(n in kept or n < 0 and x.heading for n in x.outside)

    return [x if stays(x) else GAP_LINE._replace(article=x.article) for x in lines]


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surges and dives of the windows' sums."""
    import numpy as np

    marked = any(x.article and x.text for x in lines)
    lines = [x if x.article or not marked else GAP_LINE for x in lines]
    weights = np.array([x.plain for x in lines] + [0] * window)
    here = np.array([bool(x.text) for x in lines] + [False] * window)
    if not here.any():
        return []
    if marked:
        return [x.text for x in lines if x.text]
    before = np.concatenate([[0], np.cumsum(weights)])
    sums = before[window:] - before[:-window]  # of the window that begins at a line
    filled = np.concatenate([[0], np.cumsum(here)])
    live = (filled[window:] - filled[:-window]) > 0
    # a stretch reaches from a surge, the first window with text, to the dive, the first without
    edges = np.flatnonzero(np.diff(np.concatenate([[0], live[: len(lines)].astype(int), [0]])))
    stretches = [(int(a), min(int(b) + window - 1, len(lines))) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    peaks = [int(sums[a:b].max()) for a, b in stretches]
    sizes = [sum(len(x.text) for x in lines[a:b]) for a, b in stretches]
    if max(peaks) <= 0:
        return []
    # a page's first heading of the first level begins its article; lower ones only where the densest window follows
    top = next((k for k, (a, b) in enumerate(stretches) if any(x.heading == 1 for x in lines[a:b])), 0)
    best = peaks.index(max(peaks[top:]), top)
    title = min((x.heading for a, b in stretches[: best + 1] for x in lines[a:b] if x.heading), default=0)
    first = next((k for k, (a, b) in enumerate(stretches[: best + 1]) if title and any(x.heading == title for x in lines[a:b])), None)
    out: list[str] = []
    for k, (a, b) in enumerate(stretches):
        own = [x for x in lines[a:b] if x.text]
        if k != best and all(_CLOSING.search(x.text[:200]) for x in own):
            continue
        # mostly links are no article; before the title stands none of it, and where there is no title, no short stretch either
        if k != best and (2 * sum(x.plain for x in own) < sizes[k] or (k < best and (k < first if first is not None else peaks[k] < surge))):
            continue
        if k == first:
            own = own[next(i for i, x in enumerate(own) if x.heading == title) :]
        out += [x.text for x in own]
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    return "\n\n".join(main_lines(inside_lines(*lines_of(page)), window, surge)) if page else ""


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page (page_id, url, html)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x.as_py(), window, surge) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
