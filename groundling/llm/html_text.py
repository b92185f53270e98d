"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and clustering."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import making_room

RESULT = "struct<text:string,n_lines:int,n_content_lines:int,region:string>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: A start tag of the key ends these open elements, as far up as the nearest of the scope's tags.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head", "title", "style", "script"}}
SCOPE = frozenset("article aside body div dl fieldset footer form header html main menu nav ol section table ul".split())
#: Text that no reader sees as such.
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video button select textarea".split())
NEVER = frozenset("nav aside form dialog menu footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav footer header masthead comment comments disqus replies reply share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget login signin signup search toolbar skip pagination pager".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beside a name of NAMES these make a mark doubtful, as in "content with-sidebar" or "page no-comments"; so is that of a form, as it can hold a whole page.
HOLDERS = frozenset("with no has content main article post entry story body page text wrapper wrap container layout site".split())
ROOTS = frozenset("html body".split())
#: What a line that is no content line counts against its elements, by character; and the share of the best score that decides for an article element.
AGAINST, ENOUGH = 0.5, 0.5


class Lines(HTMLParser):
    """Lines of a page as (text, tags, innermost open element, characters in links), and its elements by number, parents before children.

    Where each tag and the nearest scope are open is kept beside the open elements, so an end tag costs what it closes, however deep the page is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.tag: list[str] = ["html"]  # by element; the first stands for the page
        self.parent: list[int] = [0]
        self.mark: list[int] = [0]  # 1: doubtful
        self.open: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # tag: depths at which it is open
        self.scopes: list[int] = [0]
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.unseen = 0  # open elements of UNSEEN

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1], self.linked))
            self.tags = 0
        self.parts = []
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.line()
            if tag not in ("br", "option", "optgroup", "body", "html"):
                self._end_open({"p"})
        if tag in ENDS:
            self._end_open(ENDS[tag])
        if tag in VOID:
            return
        a = dict(attrs)
        names = re.split(r"[\s_-]+", f"{a.get('class') or ''} {a.get('id') or ''}".lower())
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        mark = 0
        if tag not in ROOTS:
            if tag in UNSEEN or tag in NEVER or (a.get("role") or "").lower() in ROLES or hidden:
                mark = 1 if tag == "form" else 2
            elif not NAMES.isdisjoint(names):
                mark = 2 if HOLDERS.isdisjoint(names) else 1
        if mark:
            self.line()
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.mark.append(mark)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.unseen += tag in UNSEEN
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe", "script"):
            self.handle_endtag(tag)

    def _cut(self, at: int) -> None:
        """Close the open elements from depth ``at`` on."""
        for e in self.open[at:]:
            self.places[self.tag[e]].pop()
            self.unseen -= self.tag[e] in UNSEEN
        while self.scopes[-1] >= at:
            self.scopes.pop()
        del self.open[at:]

    def _end_open(self, tags) -> None:
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if at and at >= self.scopes[-1]:
            self._cut(at)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.line()
        if self.places.get(tag):
            at = self.places[tag][-1]
            if any(self.mark[e] for e in self.open[at:]):
                self.line()
            self._cut(at)

    def handle_data(self, data):
        if self.unseen:
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, mirrored at the ends."""
    r = max(1, int(2 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, r, mode="symmetric" if len(ratio) >= r else "edge"), kernel / kernel.sum(), "valid")


def chosen(page: Lines, score: list[float], barred: list[bool]) -> int:
    """The element whose content lines outweigh its other lines most. An article or main element with more than half of that
    is taken instead, and the best of them where no element has content lines at all; a heading or paragraph only if nothing else is as good."""
    most = max(score)
    named = [e for e, t in enumerate(page.tag) if t in ("article", "main") and not barred[e] and (most <= 0 or score[e] >= ENOUGH * most)]
    if named:
        return max(named, key=lambda e: (score[e], -e))
    if most <= 0:
        return 0
    best = [e for e in range(len(score)) if score[e] >= most]
    return max((e for e in best if page.tag[e] != "p" and page.tag[e] not in HEADINGS), default=best[-1])


def extract(html: str | None) -> tuple[str, int, int, str]:
    """(text, lines, content lines, region's tag) of a page."""
    page = Lines()
    html = html or ""
    for at in range(0, len(html), 1 << 16):
        page.feed(html[at : at + (1 << 16)])
    page.close()
    page.line()
    lines, tag, parent = page.lines, page.tag, page.parent
    if not lines:
        return "", 0, 0, ""
    size = np.array([len(x[0]) for x in lines], float)
    smooth = smoothed(size / np.maximum([x[1] for x in lines], 1))
    content = smooth >= min(smooth.std(), smooth.mean())  # threshold clustering: at least one standard deviation

    def below(values: list[float]) -> list[float]:
        """Sums over each element and all inside it."""
        for e in range(len(values) - 1, 0, -1):
            values[parent[e]] += values[e]
        return values

    n = len(tag)
    sure = [False] * n
    for e in range(1, n):
        sure[e] = sure[parent[e]] or page.mark[e] == 2
    own = [0.0] * n
    for (_, _, e, _), s, c in zip(lines, size.tolist(), content.tolist(), strict=True):
        own[e] += s * (c and not sure[e])
    weight = below(own)
    outside = weight[0]  # content outside sure marks
    # a marked part is left out, but not a doubtful one without which next to no content would be left
    barred, inner = [False] * n, [""] * n
    for e in range(1, n):
        up = parent[e]
        inner[e] = tag[e] if tag[e] in BLOCK else inner[up]
        barred[e] = barred[up] or page.mark[e] == 2 or (page.mark[e] == 1 and outside - weight[e] >= 0.1 * outside)
    own = [0.0] * n
    for (_, _, e, _), s, c in zip(lines, size.tolist(), content.tolist(), strict=True):
        if not barred[e]:
            own[e] += s if c else -AGAINST * s
    score = below(own)
    region = chosen(page, score, barred)
    within, header = [False] * n, [False] * n
    within[region] = True
    for e in range(region + 1, n):
        within[e] = within[parent[e]]
        header[e] = within[e] and (header[parent[e]] or tag[e] == "header")
    link = [within[x[2]] and x[3] >= 0.9 * len(x[0]) for x in lines]
    named = tag[region] in ("article", "main")
    kept = []
    for i, (text, _, e, _) in enumerate(lines):
        if not within[e] or barred[e] or (header[e] and inner[e] not in HEADINGS):
            continue
        if not named and link[i] and (link[i - 1 : i] == [True] or link[i + 1 : i + 2] == [True]):
            continue  # lists of nothing but links
        kept.append(text)
    return " ".join(kept), len(lines), int(content.sum()), tag[region]


def main_text(html_col: str = "html"):
    """Column of RESULT for a column of whole pages, in Arrow batches.

    Lines are runs of text between block tags. Their text-to-tag ratios are smoothed and those above
    the threshold are content. Content lines count for the elements around them and other lines against them; the best element
    is the region (an article or main element settles near cases), and every line of it outside marked
    parts (menus, adverts, forms, comments and the like) is returned in page order. A part whose mark is doubtful
    (a form, or a class like content-with-sidebar) stays if next to no content would be left without it.
    Null, empty or textless html: empty text. Very long or deep pages: the work follows their length. Empty table: no rows. Each page stands
    alone; repeated rows give equal results.
    """

    @F.arrow_udf(RESULT)
    def extracted(pages: pa.Array) -> pa.Array:
        got = [extract(x.as_py()) for x in pages]
        cols = list(zip(*got, strict=True)) or [(), (), (), ()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["text", "n_lines", "n_content_lines", "region"])

    return extracted(F.col(html_col))


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main") -> DataFrame:
    """``pages`` with the struct column ``out_col`` (see ``main_text``); rows and other columns stay as they are, one of that name as ``out_col``_1."""
    return making_room(pages, out_col).withColumn(out_col, main_text(html_col))
