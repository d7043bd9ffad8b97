"""HTML -> markdown text (P13): the one Python step of the engine.

A page's markdown depends on element nesting (lists, links, emphasis), which
regular expressions cannot follow, so the conversion runs in Python -- as an
Arrow-batched ``mapInPandas`` over the page table, one small stdlib
``html.parser`` pass per page.  Spark partitions the pages; nothing is
collected.  Use it only on the pages that are kept (after the crawl), and
project ``html`` away right after.

Grammar (our own, not byte-compatible with any library): scripts, styles, the
title and images dropped, all other text kept; table cells separated by a
space; h1-h6 -> ``#`` prefix; paragraphs and block elements
separated by a blank line; ``<br>`` -> newline; ``<li>`` -> ``  * `` (or
``  1. `` inside ``<ol>``); ``<a href>`` -> ``[text](href)``; strong/b ->
``**``, em/i -> ``_``, code -> backticks, pre kept verbatim in a fence;
whitespace collapsed outside ``pre``; entities decoded; result stripped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "table", "tr",
          "blockquote", "ul", "ol", "dl", "dt", "dd", "figure", "form", "hr", "body", "html"}
_SKIP = {"script", "style", "title"}
_WS = re.compile(r"\s+")


class _Md(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = 0
        self.lists: list[str] = []
        self.links: list[str | None] = []

    def _break(self, n: int = 2) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
            return
        if self.skip:
            return
        a = dict(attrs)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self._break(1)
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
            self._break()
        elif tag == "li":
            self._break(1)
            self.out.append("  " * max(len(self.lists) - 1, 0) + ("  1. " if self.lists[-1:] == ["ol"] else "  * "))
        elif tag == "a":
            self.links.append(a.get("href"))
            if a.get("href") is not None:
                self.out.append("[")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self._break()
            self.out.append("```\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(self.skip - 1, 0)
            return
        if self.skip:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._break()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break()
        elif tag == "a":
            href = self.links.pop() if self.links else None
            if href is not None:
                self.out.append(f"]({href})")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(self.pre - 1, 0)
            self.out.append("\n```")
            self._break()
        elif tag in _BLOCK:
            self._break()

    def handle_data(self, data):
        if self.skip:
            return
        self.out.append(data if self.pre else _WS.sub(" ", data))

    def text(self) -> str:
        s = "".join(self.out)
        s = re.sub(r"[ \t]+\n", "\n", s)
        s = re.sub(r"\n[ \t]+(?![ *1])", "\n", s)
        s = re.sub(r"\n{3,}", "\n\n", s)
        return s.strip()


def html_to_markdown_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Md()
    try:
        p.feed(html)
        p.close()
    except Exception:  # a page that cannot be parsed converts to nothing
        return ""
    return p.text()


def html_to_markdown(pages: DataFrame, html_col: str = "html", out_col: str = "markdown") -> DataFrame:
    """Replace ``html_col`` by ``out_col`` (markdown); other columns pass through."""
    keep = [c for c in pages.columns if c != html_col]
    fields = [f for f in pages.schema.fields if f.name != html_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` string"

    def convert(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out[out_col] = [html_to_markdown_text(h) for h in pdf[html_col]]
            yield out

    return pages.select(*keep, html_col).mapInPandas(convert, schema)


