"""Main text of web pages by line-block distribution.

A page is cut into lines: one for each block element, in page order, white
space inside a block turned into one space and character references decoded.
Markup, scripts and styles are stripped.  Menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (by element, role, or a word of the
class or id) leave gaps of blank lines, and so do lines that are mostly links.

The text lengths are summed over windows of ``WINDOW`` lines.  The sums surge
where text begins and dive to zero in a gap; the lines between a surge and the
next dive form a segment.  A segment is kept when its largest sum exceeds
``THRESHOLD``, or ``SHARE`` of the page's largest sum where that is less.
This holds for every page.  Article and main elements are hints to the sums: a
line inside counts ``ARTICLE_WEIGHT`` times, their edges are gaps, and a gap
inside doesn't end them, so an article is one segment, kept or left out whole.
An article is not skipped for a word of its own class, except when it is a
comment inside another article.

Parsing is one forward scan (no backtracking; a missing end of a comment,
quote or script is looked for once).  Nulls: null html is empty and gives the
empty text; null ids and urls are kept.  Repeated rows are extracted alike; an
empty table gives no rows; extra columns are ignored.  A ``<`` that begins no
tag is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

WINDOW = 3
THRESHOLD = 86
SHARE = 0.3
#: a line is a menu if links make up more than this share of it
LINK_SHARE = 0.6
#: how often a character inside an article or main element counts
ARTICLE_WEIGHT = 2

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noembed noframes xmp".split())
SKIP = frozenset("nav footer aside form head button select dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe signup paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead topbar toolbar comment comments disqus respond reply replies share sharing social related recommended popup modal overlay "
    "pagination pager widget login search".split())
#: blocks that follow an article and may hold articles of their own
FOLLOWING = frozenset("comment comments disqus respond reply replies related recommended".split())
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:_-]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
STOP = re.compile("[>\"']")


def is_boilerplate(name: str, attributes: str) -> bool:
    """By the role, the hidden flag, or a word of the class or id."""
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "role" and value.lower() in SKIP_ROLES or key == "hidden" and value.lower() != "until-found":
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id") and name not in ("p", "h1", "main", "article") and any(w.lower() in SKIP_WORDS for w in WORD.findall(value)):
            return True
    return False


def names_of(attributes: str) -> Iterator[str]:
    """The values of class and id, lower-cased."""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            yield from (m[2] or "").strip("\"'").lower().split()


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, "")."""
    at, n = 0, len(page)
    missing: set[str] = set()  # what does not occur any more from here on

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < n:
        lt = find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if m is None:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end = m.end()
        while True:  # the end of the tag, outside quotes
            s = STOP.search(page, end) if ">" not in missing else None
            if s is None:
                missing.add(">")
                end = n
                break
            if s[0] == ">":
                end = s.start()
                break
            quote = find(s[0], s.end())
            if quote < 0:
                gt = find(">", s.end())
                end = n if gt < 0 else gt
                break
            end = quote + 1
        name, attributes = m[0].lower(), page[m.end():end]
        at = min(n, end + 1)
        if closing:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW and not attributes.endswith("/"):
            key = "</" + name
            stop = None
            if key not in missing:
                stop = re.compile(re.escape(key) + r"(?=[\s/>])", re.I).search(page, at)
                if stop is None:
                    missing.add(key)
            at = n if stop is None else stop.start()


class _Page:
    """Collects lines as (text, in article or main); blank lines are gaps."""

    def __init__(self):
        self.lines: list[tuple[str, bool]] = []
        self.open: list[str] = []  # open elements
        self.skip_at = 0  # number of open elements up to the one that is skipped; 0: none
        self.skip_follows = False  # the skipped element holds comments or the like
        self.articles = 0  # open article and main elements
        self.posts = 0  # open article elements
        self.seen = False  # an article or main element had text
        self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0

    def flush(self) -> None:
        if self.parts:
            line = " ".join(html.unescape("".join(self.parts)).split())
            self.parts = []
            if line:
                inside = self.articles > 0
                if not inside and self.link_chars > LINK_SHARE * len(line):
                    self.gap()
                else:
                    self.lines.append((line, inside))
                    self.seen |= inside
        self.link_chars = 0

    def gap(self) -> None:
        if not self.articles:
            self.lines.extend([("", False)] * WINDOW)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self.skip_at:
                self.parts.append(" ")
            return
        if name in BLOCK:
            if not self.skip_at:
                self.flush()
            if self.open and self.open[-1] in CLOSED_BY_BLOCK:
                self.end(self.open[-1])
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return
        if name in RAW and self.skip_at:
            self.open.append(name)
            return
        skip = name in RAW or name in SKIP or name == "header" and not self.articles or is_boilerplate(name, attributes)
        skip = skip or name == "article" and self.posts > 0 and any(x in FOLLOWING for x in names_of(attributes))
        if name in ("article", "main") and not skip:
            if (self.skip_at and self.open[self.skip_at - 1] not in ("aside", "footer") and not self.posts
                    and not (self.skip_follows and self.seen)):
                while len(self.open) >= self.skip_at:  # an unclosed notice or menu ends where the article begins
                    self.open.pop()
                self.skip_at = 0
            if not self.skip_at:
                self.gap()
                self.articles += 1
                self.posts += name == "article"
        self.open.append(name)
        if skip and not self.skip_at:
            self.skip_at = len(self.open)
            self.skip_follows = any(w.lower() in FOLLOWING for x in names_of(attributes) for w in WORD.findall(x))
            if name not in RAW:
                self.flush()
                self.gap()
        elif name == "a" and not self.skip_at:
            self.links += 1

    def end(self, name: str) -> None:
        if name in BLOCK and not self.skip_at:
            self.flush()
        if name not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.skip_at == len(self.open) + 1:
                self.skip_at = 0
            elif not self.skip_at and last == "a":
                self.links -= 1
            elif not self.skip_at and last in ("article", "main"):
                self.flush()
                self.articles = max(0, self.articles - 1)
                self.posts = max(0, self.posts - (last == "article"))
                self.gap()
            if last == name:
                return

    def text(self, data: str) -> None:
        if not self.skip_at:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def page_lines(page: str) -> list[tuple[str, bool]]:
    p = _Page()
    for kind, a, b in events(page):
        if kind == "text":
            p.text(a)
        elif kind == "open":
            p.start(a, b)
        else:
            p.end(a)
    p.flush()
    return p.lines


def segments(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, largest sum): runs of lines between a surge and a dive of
    the window sums to zero."""
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            out.append((start, i, max(sums[start:i])))
            start = None
    return out


def main_text(page: str | None) -> str:
    """The kept blocks, joined by one line feed."""
    lines = page_lines(page or "")
    found = segments([len(line) * (ARTICLE_WEIGHT if inside else 1) for line, inside in lines])
    least = min(THRESHOLD, SHARE * max((s[2] for s in found), default=0))
    return "\n".join(line for a, b, top in found if top > least for line, _ in lines[a:b] if line)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("html"))
            for lo in range(0, batch.num_rows, 256):
                texts = [main_text(x.as_py()) for x in column.slice(lo, 256)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).slice(lo, n) for c in ("page_id", "url")),
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
