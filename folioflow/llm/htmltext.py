"""Main text of web pages: parser events make lines, smoothed text-to-tag ratios find the content regions.

The standard library's parser streams events; every block element starts a new line, which carries its text, its number
of tags and the element it stands in. The text-to-tag ratios of all lines outside page furniture are smoothed with a
Gaussian and parted into two clusters by a threshold midway between the clusters' means (on a logarithmic scale). Lines above
it are dense. Runs of dense lines say where the content is: the outermost articles and main elements around them, or
else the innermost element around all large runs. All lines of that element are kept, sparse ones (titles, short
paragraphs, lists) too, and nothing outside it. Names of classes and ids are looked at only inside the region, for what no
ratio can tell from a short paragraph: adverts, comments and the like.
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

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never shown, or is furniture wherever it stands.
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select option button datalist title".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of classes and ids, looked at inside a content region only: the whole name, or one with words for place and kind of box around it.
_WORD = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|related|share|sharing|social|notice|newsletter|subscri\w*|comments?|replies|respond|sidebar|cookies?|popup|menu|breadcrumbs?|footer|pagination)"
_PLAIN = r"(?:site|page|main|top|bottom|left|right|bar|block|box|container|wrapper|inner|section|area|list|items?|links?|slot|unit|\d+)"
_MARKED = re.compile(rf"(?:{_PLAIN}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PLAIN}|form|posts?|articles?))*", re.I)
#: What may stand in a head; any other element ends it.
_IN_HEAD = frozenset("base link meta title style script noscript template object".split())
_REGIONS = frozenset(("article", "main"))
_CONTAINERS = frozenset("article main section div td body html".split())
#: A start tag closes an open element of these kinds first.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPE = frozenset("ul ol dl table select article section main div body td".split())
_PARAGRAPH_SCOPE = frozenset("td th li div article section main body blockquote".split())


class Lines(HTMLParser):
    """Collects [parts (text, element), elements around each tag] for every line outside what is silent or hidden.

    Elements are numbers, each with its name and its parent (a smaller number, -1 for none); ``marks`` holds those that look like
    furniture: 1 by class or id, 2 by name or role. Memory is in proportion to the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int]] = []  # name, number, silent from here on, block elements up to here
        self.names: list[str] = []
        self.parents: list[int] = []
        self.marks: dict[int, int] = {}
        self.lines: list[list] = []
        self.count: Counter = Counter()  # open elements by name
        self.muted, self.open = 0, False

    def _hidden(self, tag: str, got: dict[str, str | None]) -> bool:
        return tag in SILENT or "hidden" in got or got.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style") or "", re.I))

    def _mark(self, tag: str, got: dict[str, str | None]) -> int:
        if tag in FURNITURE or (got.get("role") or "").strip().lower() in ROLES:
            return 1 if tag == "form" else 2
        if tag == "header":
            return 0 if self.count["article"] or self.count["main"] else 2
        if tag in ("html", "body", "article", "main"):
            return 0
        return int(any(_MARKED.fullmatch(x) for k in ("class", "id") for x in (got.get(k) or "").split()))

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in _IN_HEAD):
            self._end("head")
        if tag == "p" or tag in BLOCKS:
            self._end("p", _PARAGRAPH_SCOPE)
        for name in _CLOSES.get(tag, ()):
            self._end(name, _SCOPE)
        around = self.stack[-1][1] if self.stack else -1
        if tag in BLOCKS or tag == "br":
            self.open = False
        elif self.lines and not self.muted:
            self.lines[-1][1].append(around)
        if tag in VOID:
            return
        got = dict(attrs)
        hidden = self._hidden(tag, got)
        if mark := self._mark(tag, got):
            self.marks[len(self.names)] = mark
        self.parents.append(around)
        self.names.append(tag)
        self.stack.append((tag, len(self.names) - 1, hidden, (self.stack[-1][3] if self.stack else 0) + (tag in BLOCKS)))
        self.count[tag] += 1
        self.muted += hidden

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _end(self, name: str, stop: frozenset = frozenset()):
        """Ends the innermost open ``name``, unless one of ``stop`` lies inside it."""
        if self.count[name]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    return self._pop(i)
                if self.stack[i][0] in stop:
                    return None

    def _pop(self, to: int):
        for name, _, silent, _ in self.stack[to:]:
            self.muted -= silent
            self.count[name] -= 1
        del self.stack[to:]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.open = False
        if self.count[tag]:
            i = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
            if tag in BLOCKS or self.stack[-1][3] == self.stack[i][3]:  # an inline end tag ends nothing across blocks
                self._pop(i)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end("head")
        if self.muted:
            return
        if not self.open:
            if not data.strip():
                return
            self.lines.append([[], []])
            self.open = True
        self.lines[-1][0].append((data, self.stack[-1][1] if self.stack else -1))

    def inside(self, chosen: set[int]) -> list[bool]:
        """Per element (the last place: outside all of them, -1) whether it is or lies in a chosen one."""
        out = [False] * (len(self.names) + 1)
        out[-1] = -1 in chosen
        for i, parent in enumerate(self.parents):
            out[i] = i in chosen or out[parent]
        return out

    def weights(self, lines: list[tuple[int, int]]) -> list[int]:
        """Per element the characters of the lines (characters, element) in it."""
        out = [0] * (len(self.names) + 1)
        for n, at in lines:
            out[at] += n
        for i in range(len(self.names) - 1, -1, -1):
            out[self.parents[i]] += out[i]
        return out


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    pad = np.concatenate([np.zeros(r), ratio, np.zeros(r)])
    return np.convolve(pad, k / k.sum(), "valid")


def dense_lines(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines lie in the upper of two clusters of smoothed text-to-tag ratios; all, if the clusters differ by less than a factor of 2.

    Smoothing bridges short lines inside a run of long ones; where a run ends, lines that are above only by their neighbour's ratio are cut off.
    """
    x = np.log(smoothed(chars / tags) + 1)
    cut = (x.min() + x.max()) / 2
    for _ in range(50):
        low, high = x[x < cut], x[x >= cut]
        if not len(low):
            break
        if (new := (low.mean() + high.mean()) / 2) == cut:
            break
        cut = new
    if not len(low) or high.mean() - low.mean() < np.log(2):
        return np.ones(len(x), bool)
    dense = x >= cut
    own = np.log(chars / tags + 1) >= cut
    run = np.cumsum(np.diff(dense, prepend=False))
    for r in np.unique(run[dense]):
        at = np.flatnonzero(dense & (run == r))
        inner = at[own[at]]
        dense[at] = (at >= inner[0]) & (at <= inner[-1]) if len(inner) else False
    return dense if dense.any() else np.ones(len(x), bool)


def regions(p: Lines, lines: list[tuple[int, int]], dense: np.ndarray, small: float = 0.2) -> set[int]:
    """The elements whose lines are the content: outermost articles and main elements with dense lines, if they hold half of
    the dense text; else the innermost element around all runs of dense lines but those with under ``small`` of the largest's text."""
    outer: list[int] = []  # per element the outermost article or main around it, -1 for none
    for i, parent in enumerate(p.parents):
        outer.append(outer[parent] if parent >= 0 and outer[parent] >= 0 else i if p.names[i] in _REGIONS else -1)
    found: Counter = Counter()
    for (n, at), d in zip(lines, dense, strict=True):
        found[outer[at] if d and at >= 0 else -1] += n * int(d)
    total = found.pop(-1, 0) + sum(found.values())
    found = Counter({r: n for r, n in found.items() if n})
    if found and 2 * found.total() >= total:
        return set(found)
    runs: list[list[int]] = []
    for i in np.flatnonzero(dense).tolist():
        if runs and i - runs[-1][-1] <= 2:
            runs[-1].append(i)
        else:
            runs.append([i])
    most = max(sum(lines[i][0] for i in r) for r in runs)
    chosen = [lines[i] for r in runs if sum(lines[i][0] for i in r) >= small * most for i in r]
    held = p.weights(chosen)
    whole = sum(n for n, _ in chosen)
    return {max((i for i, name in enumerate(p.names) if held[i] == whole and name in _CONTAINERS), default=-1)}


def main_text(html: str | None, find=dense_lines) -> str:
    """Blocks of the content regions in page order, each with single spaces, joined by a space; no content: empty. ``find``: which lines are dense."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    own = [(len("".join(t.split())), at) for parts, _ in p.lines for t, at in parts]
    held = p.weights(own)
    around_main = set()
    for i in range(len(p.names) - 1, -1, -1):
        if (p.names[i] == "main" and held[i]) or i in around_main:
            around_main.add(p.parents[i])
    free = p.inside({x for x, kind in p.marks.items() if kind == 2 and x not in around_main})
    spare_articles = not any(name in _REGIONS and held[i] and not free[i] for i, name in enumerate(p.names))
    if spare_articles:  # no article or main stands outside furniture: then what stands around one is none
        for i in range(len(p.names) - 1, -1, -1):
            if (p.names[i] == "article" and held[i]) or i in around_main:
                around_main.add(p.parents[i])
    away = p.inside({x for x, kind in p.marks.items() if kind == 2 and x not in around_main})

    lines: list[list] = []

    def read(gone: list[bool]) -> None:
        lines.clear()
        for parts, tags in p.lines:
            kept = [x for x in parts if not gone[x[1]]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text:
                lines.append([text, 1, next(at for t, at in kept if t.strip())])
            if lines:
                lines[-1][1] += sum(not gone[x] for x in tags)

    read(away)
    if not lines:
        return ""
    where = [(len(t), at) for t, _, at in lines]
    chosen = regions(p, where, find(np.array([n for n, _ in where]), np.array([tags for _, tags, _ in lines])))
    kept = p.inside(chosen)
    inner = p.weights([x for x in where if kept[x[1]]])
    most = sum(n for n, at in where if kept[at])
    hints = {x for x, kind in p.marks.items() if kind == 1 and x not in around_main and x not in chosen and 2 * inner[x] <= most}
    away = p.inside({x for x, kind in p.marks.items() if kind == 2 and x not in around_main} | hints)
    read(away)
    return " ".join(t for t, _, at in lines if kept[at])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page. Null and empty pages give the empty text; repeated rows stay repeated; no rows: no rows. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                text = [main_text(h.as_py()) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), "url", F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
