"""HTML expressions (Column -> Column): invisible-element removal, visible
text, text ratio, framework markers, dynamic-page flag and href values.

Everything here is a regular expression or string function evaluated in
the JVM; no DOM is built.  The grammar is the one of a forgiving tag
tokenizer: a tag starts with '<' followed by a letter, '/', '!' or '?' and
ends at the next '>'; ``<script>``/``<style>`` content and comments are
invisible; an unterminated script/style runs to the end of the document.
Known limits: '>' inside a quoted attribute value ends the tag early, and
only the entities listed below are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the crawler's classifier) ---------------------
# Framework name -> case-insensitive patterns; a framework is reported when
# any of its patterns matches the raw HTML.  Order is the reporting order.
FRAMEWORK_PATTERNS = {
    "React": [r"""<div[^>]+id=["']root["']""", r"data-reactroot", r"data-react-"],
    "Vue": [r"""<div[^>]+id=["']app["']""", r"v-cloak", r"v-if", r"v-for"],
    "Angular": [r"ng-app", r"ng-controller", r"ng-model"],
    "Next.js": [r"__NEXT_DATA__", r"_next/static"],
    "Nuxt": [r"__NUXT__"],
}
# A page is dynamic when a framework is found and text/html is below this.
TEXT_RATIO_THRESHOLD = 0.1
# --------------------------------------------------------------------------

# Python's str.isspace() set, so stripping matches str.strip().
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Invisible parts: comments, script and style elements (an unterminated one
# runs to the end), in document order (leftmost match wins).
INVISIBLE = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b[^>]*>.*?</script\s*>|script\b[^>]*>.*"
    r"|style\b[^>]*>.*?</style\s*>|style\b[^>]*>.*)"
)
TAG = r"<[A-Za-z/!?][^>]*>"
# What separates text nodes: invisible elements and tags.
NON_TEXT = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b[^>]*>.*?</script\s*>|script\b[^>]*>.*"
    r"|style\b[^>]*>.*?</style\s*>|style\b[^>]*>.*"
    r"|[A-Za-z/!?][^>]*>)"
)
# Stands for a '<' after the last '>' of a page, where it can begin no tag.
_NO_TAG = "\ue000"

# Entities decoded in text; '&amp;' must come last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"),
    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"),
]

# An <a> tag with its attributes (group 1), and in them the first href
# outside other values: double-quoted, single-quoted or bare.  All loops are
# possessive, so they neither recurse nor go back.
A_TAG = r"""(?is)<a(?=\s)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s>"']++)"""
HREF = (r"""(?is)^(?:"[^"]*+"|'[^']*+'|(?!\shref\s*+=\s*+""" + _VALUE.replace("(", "(?:", 1) + r""")[^'"])*+"""
        r"""\shref\s*+=\s*+""" + _VALUE)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(c) -> Column:
    src = _col(c)
    out = src
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    # most text has no '&': skip the replace chain for it
    return F.when(F.instr(src, "&") > 0, out).otherwise(src)


def strip_invisible(html) -> Column:
    """Remove comments and <script>/<style> elements with their content."""
    return F.regexp_replace(_col(html), INVISIBLE, "")


def visible_text(html) -> Column:
    """Stripped text nodes concatenated without separator: the page is split at
    tags, each piece decoded and trimmed (linear in any run of white space)."""
    h = _col(html)
    tail = F.substring_index(h, ">", -1)
    bare = F.concat(F.substring(h, F.lit(1), F.length(h) - F.length(tail)), F.translate(tail, "<", _NO_TAG))

    def text(page: Column) -> Column:
        def trim(x: Column) -> Column:
            return F.btrim(x, F.lit(WS_CHARS))

        pieces = F.split(page, NON_TEXT, -1)
        # most pages have entities in a few places only, some have none
        return F.array_join(F.when(F.instr(page, "&") > 0, F.transform(pieces, lambda x: trim(decode_entities(x))))
                            .otherwise(F.transform(pieces, trim)), "")

    return F.when(F.instr(tail, "<") > 0, F.translate(text(bare), _NO_TAG, "<")).otherwise(text(h))


def text_ratio(html) -> Column:
    """len(visible text) / len(html); 0.0 for empty html, 1.0 where there is no
    html to read (such a page counts as static)."""
    h = _col(html)
    return ratio_of(F.length(visible_text(h)), F.length(h))


def ratio_of(text_len, html_len) -> Column:
    """:func:`text_ratio` from both lengths."""
    n = _col(html_len)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(_col(text_len) / n, F.lit(1.0)))


def framework_regex(name: str) -> str:
    return "(?i)(?:" + "|".join(FRAMEWORK_PATTERNS[name]) + ")"


_META = set(".^$*+?{}[]\\|()")


def _pattern_hit(low: Column, pattern: str) -> Column:
    """Case-insensitive search of ``pattern`` in the lower-cased html: plain
    literals are substring tests, the rest regexes."""
    if not any(ch in _META for ch in pattern):
        return low.contains(pattern.lower())
    return low.rlike(pattern if pattern == pattern.lower() else "(?i)" + pattern)


def framework_hits(html) -> list[Column]:
    """One nullable name column per framework, in reporting order; the html
    is lower-cased once (shared by all tests in the projection)."""
    low = F.lower(_col(html))
    out = []
    for name, patterns in FRAMEWORK_PATTERNS.items():
        cond = _pattern_hit(low, patterns[0])
        for p in patterns[1:]:
            cond = cond | _pattern_hit(low, p)
        out.append(F.when(cond, F.lit(name)))
    return out


def framework_list(html) -> Column:
    """Detected framework names joined by ',' ('' when none)."""
    return F.concat_ws(",", *framework_hits(html))


def detect_frameworks(html) -> Column:
    """Ordered array of detected framework names."""
    return F.filter(F.array(*framework_hits(html)), lambda x: x.isNotNull())


def is_dynamic(frameworks: Column, ratio: Column) -> Column:
    return (F.size(frameworks) > 0) & (ratio < F.lit(TEXT_RATIO_THRESHOLD))


def href_values(html) -> Column:
    """All <a href> values (unquoted, entities decoded), in document order."""
    tags = F.regexp_extract_all(strip_invisible(html), F.lit(A_TAG), 1)
    raw = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, HREF, 1)), lambda v: v != "")
    return F.transform(raw, lambda v: decode_entities(F.regexp_replace(v, r"""^["']|["']$""", "")))
