"""SQL (DuckDB dialect) twins of the Column expressions, for the oracle.

The HTML and URL forms are written here on their own, from the grammar, and
share no pattern with :mod:`quire.functions`; only names and thresholds that
both must equal (framework names and markers, white space) are imported.
"""

from __future__ import annotations

from html import unescape

from quire.functions import html as H


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rx_replace(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


# --- URLs -------------------------------------------------------------------
#: RFC 3986 scheme; blanks and controls around a URL, and the three characters
#: that the URL standard removes anywhere
SCHEME = "^([a-zA-Z][a-zA-Z0-9+.-]*):"


def clean_url(u: str) -> str:
    return f"translate(ltrim({u}, {' || '.join(f'chr({c})' for c in range(1, 33))}), chr(9) || chr(10) || chr(13), '')"


def url_scheme(u: str) -> str:
    return f"lower(regexp_extract({clean_url(u)}, {lit(SCHEME)}, 1))"


def after_scheme(u: str) -> str:
    return rx_replace(clean_url(u), SCHEME)


def netloc_of_rest(rest: str) -> str:
    return f"regexp_extract({rest}, '^//([^/?#]*)', 1)"


def after_netloc(rest: str) -> str:
    return rx_replace(rest, r"^//[^/?#]*")


def url_netloc(u: str) -> str:
    return netloc_of_rest(after_scheme(u))


def url_path(u: str) -> str:
    return f"regexp_extract({after_netloc(after_scheme(u))}, '^([^?#]*)', 1)"


def url_query(u: str) -> str:
    return f"regexp_extract({after_netloc(after_scheme(u))}, '^[^?#]*\\?([^#]*)', 1)"


def is_url(u: str) -> str:
    return f"coalesce({url_scheme(u)} IN ('http', 'https') AND {url_netloc(u)} <> '', false)"


def defrag(u: str) -> str:
    return rx_replace(u, r"(?s)#.*$")


def scope_path(u: str) -> str:
    return rx_replace(url_path(u), r"/+$")


def host_slug(u: str) -> str:
    return f"replace({url_netloc(u)}, '.', '_')"


def file_name(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def file_stem(p: str) -> str:
    return f"regexp_replace({file_name(p)}, '(.)\\.[^.]+$', '\\1')"


def file_ext(p: str) -> str:
    return f"lower(regexp_extract({file_name(p)}, '.(\\.[^.]+)$', 1))"


# --- HTML -------------------------------------------------------------------
ENTITY_NAMES = "lt gt quot #39 apos nbsp copy middot reg hellip mdash ndash amp".split()
COMMENT = "<!--(?s:.*?)-->"


def element_with_content(name: str) -> str:
    """From a start tag to its end tag or, without one, to the end."""
    return f"(?is:<{name}(?:[^a-z0-9_>][^>]*)?>(?:.*?</{name}[ \\t\\n\\f\\r\\v]*>|.*))"


HIDDEN = "|".join([COMMENT, element_with_content("script"), element_with_content("style")])
MARKUP = HIDDEN + "|</?[a-zA-Z][^>]*>|<[/!?][^>]*>"


def decode_entities(x: str) -> str:
    for name in ENTITY_NAMES:
        x = f"replace({x}, '&{name};', chr({ord(unescape(f'&{name};'))}))"
    return x


def strip_invisible(h: str) -> str:
    return rx_replace(h, HIDDEN)


def visible_text(h: str) -> str:
    ws_sql = " || ".join(f"chr({ord(c)})" for c in H.WS_CHARS)
    return f"list_aggregate(list_transform(string_split_regex({h}, {lit(MARKUP)}), lambda t: trim({decode_entities('t')}, {ws_sql})), 'string_agg', '')"


def frameworks(h: str) -> str:
    parts = [f"CASE WHEN regexp_matches({h}, {lit(H.framework_regex(n))}) THEN {lit(n)} END"
             for n in H.FRAMEWORK_PATTERNS]
    return "concat_ws(',', " + ", ".join(parts) + ")"


# RE2 form of H.HREF (no look-ahead): '<a' + whitespace, attributes, href.
HREF_RE2 = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def href_values(h: str) -> str:
    """List of decoded href values (apply :func:`unquote_decode` per element)."""
    return f"regexp_extract_all({strip_invisible(h)}, {lit(HREF_RE2)}, 1)"


def unquote_decode(v: str) -> str:
    return decode_entities(rx_replace(v, r"""^["']|["']$"""))


def url_join_ctes(src_cte: str, base: str, href: str, out: str) -> list[tuple[str, str]]:
    """CTE steps resolving ``href`` against ``base`` (both columns of
    ``src_cte``); the last CTE adds column ``out``.  Returns [(name, sql)]."""
    s1 = f"""SELECT *, {url_scheme(base)} AS _bs, {url_netloc(base)} AS _bn,
        regexp_extract({after_netloc(after_scheme(base))}, '^([^?#]*)', 1) AS _bp,
        regexp_extract({after_netloc(after_scheme(base))}, '^[^?#]*\\?([^#]*)', 1) AS _bq,
        {url_scheme(href)} AS _hs, {netloc_of_rest(after_scheme(href))} AS _hn,
        regexp_extract({after_netloc(after_scheme(href))}, '^([^?#]*)', 1) AS _hp,
        regexp_extract({after_netloc(after_scheme(href))}, '^[^?#]*\\?([^#]*)', 1) AS _hq
      FROM {src_cte}"""
    s2 = """SELECT *, CASE WHEN string_split(_bp, '/')[-1] <> ''
                THEN list_slice(string_split(_bp, '/'), 1, len(string_split(_bp, '/')) - 1)
                ELSE string_split(_bp, '/') END AS _bdir
      FROM uj1"""
    s3 = """SELECT *, list_concat(_bdir, string_split(_hp, '/')) AS _merged FROM uj2"""
    s4 = """SELECT *, CASE WHEN starts_with(_hp, '/') THEN string_split(_hp, '/')
                ELSE list_filter(_merged, lambda x, i: i = 1 OR i = len(_merged) OR x <> '') END AS _segs
      FROM uj3"""
    s5 = """SELECT *, list_reduce(_segs, lambda acc, s: CASE WHEN s = '..' THEN
                  (CASE WHEN len(acc) > 0 THEN list_slice(acc, 1, len(acc) - 1) ELSE acc END)
                WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[]) AS _fold
      FROM uj4"""
    s6 = """SELECT *, array_to_string(CASE WHEN _segs[-1] IN ('.', '..') THEN list_append(_fold, '')
                ELSE _fold END, '/') AS _path0
      FROM uj5"""
    q = "CASE WHEN {x} <> '' THEN '?' || {x} ELSE '' END"
    s7 = f"""SELECT *, CASE WHEN {href} = '' THEN {base}
                WHEN _hs <> '' AND _hs <> _bs THEN {href}
                WHEN _hn <> '' THEN _bs || '://' || _hn || _hp || {q.format(x='_hq')}
                WHEN _hp = '' THEN _bs || '://' || _bn || _bp
                     || {q.format(x="CASE WHEN _hq <> '' THEN _hq ELSE _bq END")}
                ELSE _bs || '://' || _bn
                     || CASE WHEN _path0 = '' THEN '/' WHEN starts_with(_path0, '/') THEN _path0
                             ELSE '/' || _path0 END
                     || {q.format(x='_hq')} END AS {out}
      FROM uj6"""
    return [("uj1", s1), ("uj2", s2), ("uj3", s3), ("uj4", s4), ("uj5", s5), ("uj6", s6), ("uj7", s7)]
