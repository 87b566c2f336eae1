"""Main text of web pages by line-block distribution.

The page becomes lines, one per block element; markup, scripts, styles, forms
and elements that name themselves as menus, headers, footers, sidebars, notices,
adverts or comments leave empty lines, unless they lie between blocks of one part
or hold nearly all text.  Text lengths (without link text) are
summed over sliding windows of lines.  A run of lines starts at a surge (the
window sum rises from zero past the threshold) and ends at a dive (back to
zero).  If the page marks its article or main part, that part is the run.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
SURGE = 40
GAP = WINDOW + 1

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "canvas", "select", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "head",
}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "input", "fieldset"}
CONTAINERS = {"article", "main"}
#: Words of a class, id or role that name a part outside the article.
PARTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "masthead", "footer", "sidebar", "aside", "widget", "widgets", "related", "recommended", "complementary", "contentinfo",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "disclaimer",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social",
    "comment", "comments", "discussion", "disqus", "replies", "reply", "respond", "navigationbar",
}
#: Words that may stand beside one of PARTS in a name; any other word (as in no-sidebar or comments-open) makes it another name.
BESIDE = {
    "box", "wrapper", "wrap", "container", "list", "area", "section", "block", "left", "right", "top", "bottom", "bar", "inner", "outer",
    "item", "items", "link", "links", "button", "buttons", "site", "page", "post", "posts", "form", "primary", "secondary", "main",
    "column", "col", "panel", "unit", "slot", "icons", "title", "header", "holder", "group", "row", "thread", "global", "fixed", "sticky",
}
#: A part that its class, id or role names, but that holds more than this share of the text, is not dropped.
MOST = 0.9
#: Blocks that only arrange text inside a larger part.
FLOW = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "address", "ul", "ol", "li", "dl", "dt", "dd", "figure", "figcaption",
    "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "hr", "details", "summary",
}
HEADS = {"header", "site-header", "page-header", "topbar", "top-bar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_SPACE = re.compile(r"\s+")


def outside(name: str, attributes: str) -> str | None:
    """How an element says that it is not part of the article: by "kind" (element or hidden) or by "name"."""
    if name in BOILERPLATE:
        return "kind"
    if name in ("html", "body", "main") or not attributes:
        return None
    if _HIDDEN.search(attributes):
        return "kind"
    for _, *values in _NAMES.findall(attributes):
        for label in "".join(values).lower().split():
            words = set(re.split(r"[^a-z]+", label)) - {""}
            if label in HEADS or (words & PARTS and words <= PARTS | BESIDE):
                return "name"
    return None


class _Page:
    """Lines of a page: (text, letters outside links, container, dropped by, home); a gap is its home."""

    def __init__(self) -> None:
        self.lines, self.words, self.plain = [], [], 0
        self.stack = []          # (name, dropping elements around it, container, in a link, drops itself, home)
        self.holds = {}          # dropping element -> holds a container of its own
        self.named = set()       # dropping elements that only their class, id or role names
        self.homes = 0           # a home is the innermost part that is not just a block of text
        self.containers, self.clear = 0, False   # clear: a container stands outside all dropped elements

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.words))).strip()
        if text:
            top = self.stack[-1] if self.stack else (None, (), 0, False, None, 0)
            self.lines.append((text, self.plain, top[2], top[1], top[5]))
        self.words, self.plain = [], 0

    def gap(self, at: int) -> None:
        """Where the element at ``at`` of the stack begins or ends; inside a dropped element nothing needs one."""
        around = self.stack[at - 1] if at else (None, (), 0, False, None, 0)
        if not around[1]:
            self.lines.append(around[5])

    def text(self, text: str) -> None:
        if text:
            self.words.append(text)
            if not (self.stack and self.stack[-1][3]):
                self.plain += len(text.strip())

    def close(self, at: int) -> None:
        if any(x[0] in BLOCKS for x in self.stack[at:]):
            self.flush()
        if gone := [k for k in range(at, len(self.stack)) if self.stack[k][4]]:
            self.gap(gone[0])
        del self.stack[at:]

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._implied_end(name)
            self.flush()
        elif name == "br":
            self.words.append(" ")
        if name in VOID:
            return
        _, drops, container, link, _, home = self.stack[-1] if self.stack else (None, (), 0, False, None, 0)
        why = outside(name, attributes)
        is_out = bool(why) or (name == "header" and not container)
        if is_out:
            self.flush()
            self.gap(len(self.stack))
            if why == "name":
                self.named.add(len(self.holds))
            self.holds[len(self.holds)] = False
            drops = drops + (len(self.holds) - 1,)
        elif name in CONTAINERS:
            self.clear |= not drops
            for k in drops:
                self.holds[k] = True
            if not container or not drops:
                self.containers += 1
                container = container or self.containers
        if is_out or (name in BLOCKS and name not in FLOW):
            self.homes += 1
            home = self.homes
        self.stack.append((name, drops, container, link or name == "a", is_out, home))

    def _implied_end(self, name: str) -> None:
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(name, ("p",))
        for at in range(len(self.stack) - 1, -1, -1):
            open_name = self.stack[at][0]
            if open_name in closes:
                self.close(at)
                return
            if open_name in BLOCKS and open_name != "p":
                return

    def end(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                self.close(at)
                return
            if self.stack[at][0] in CONTAINERS and name not in ("body", "html", "article", "main"):
                return


def page_lines(source: str) -> list:
    """(text, plain characters, container) per block that no dropped element holds; None for a gap."""
    page, at, found = _Page(), 0, None
    raw_end = None
    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            page.text(source[at:])
            break
        page.text(source[at:found.start()])
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            page.end(name)
        elif name in RAW:
            if not found.group(3).endswith("/"):
                raw_end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = raw_end.end() if raw_end else len(source)
        else:
            page.start(name, found.group(3))
    page.flush()
    most = _held_most(page)
    lines, gaps, home = [], [], None
    for line in page.lines:
        if isinstance(line, int):
            gaps.append(line)
            continue
        drops = [k for k in line[3] if k not in most]
        if not drops or (not page.clear and all(page.holds[k] for k in drops)):
            # What is removed between two blocks of one part does not separate them.
            if any(g != home or g != line[4] for g in gaps):
                lines.append(None)
            lines.append(line[:3])
            gaps, home = [], line[4]
    return lines


def _held_most(page: _Page) -> set:
    """Parts dropped by name alone that hold most of the text outside the parts dropped by kind."""
    sizes, total = dict.fromkeys(page.named, 0), 0
    for line in page.lines:
        if not isinstance(line, int) and page.named.issuperset(line[3]):
            total += len(line[0])
            for k in line[3]:
                sizes[k] += len(line[0])
    return {k for k, size in sizes.items() if size > MOST * total}


def blocks(plain: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs of lines between a surge and the next dive of the window sums.

    A page whose largest window sum is below the threshold surges there.
    """
    if not plain.any():
        return []
    sums = np.convolve(plain, np.ones(window, dtype=np.int64))[window - 1:]
    surge = min(surge, int(sums.max()))
    runs, start, peak = [], None, 0
    for k, total in enumerate(sums):
        if start is None and plain[k] > 0:
            start, peak = k, 0
        if start is not None:
            peak = max(peak, total)
            dive = total == 0
            if dive or k == len(sums) - 1:
                if peak >= surge:
                    runs.append((start, k if dive else k + 1))
                start = None
    return runs


def main_text(source: str | None) -> str:
    """Blocks of the main text, one per line; empty for null, empty or textless pages."""
    lines = page_lines(source or "")
    if any(line is not None and line[2] for line in lines):
        # Inside a marked part nothing separates blocks, and link text counts; outside it nothing counts.
        lines = [(line[0], len(line[0])) for line in lines if line is not None and line[2]]
    spread: list = []
    for line in lines:
        spread += [None] * GAP if line is None else [line]
    plain = np.array([0 if line is None else line[1] for line in spread], dtype=np.int64)
    return "\n".join(line[0] for s, e in blocks(plain) for line in spread[s:e] if line is not None)


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page, url, ``text`` and ``n_chars`` (code points) of every row.

    Null and empty pages and pages without text have an empty text.  Rows and
    ties are independent of each other; other columns are not read.
    """
    rows = pages.select(page, url, F.col(source).cast("string").alias("_html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:2], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
