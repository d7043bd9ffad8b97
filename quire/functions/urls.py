"""URL expressions (Column -> Column), all native Catalyst expressions.

Semantics follow Python's ``urllib.parse`` as used by a crawler: scheme is
case-insensitive, the netloc keeps its case and port, a fragment is cut
before joining, and relative references are resolved per RFC 3986 with
the dot-segment fold done by ``aggregate`` over the path segments.
Path parameters (``;p`` in the last segment) are not split off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters urlsplit strips from the start of a URL and removes anywhere.
_LEADING_JUNK = r"^[\x00-\x20]+"
_UNSAFE = r"[\t\r\n]"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_url(u) -> Column:
    """What urlsplit does first: drop leading C0/space and any tab/CR/LF."""
    return F.regexp_replace(F.regexp_replace(_col(u), _LEADING_JUNK, ""), _UNSAFE, "")


def url_scheme(u) -> Column:
    """Lower-cased scheme or ''."""
    return F.lower(F.regexp_extract(clean_url(u), _SCHEME, 1))


def _after_scheme(u) -> Column:
    return F.regexp_replace(clean_url(u), _SCHEME, "")


def _netloc_of_rest(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^//([^/?#]*)", 1)


def _after_netloc(rest: Column) -> Column:
    return F.regexp_replace(rest, r"^//[^/?#]*", "")


def url_netloc(u) -> Column:
    """Host with port, case kept ('' when there is no authority)."""
    return _netloc_of_rest(_after_scheme(u))


def url_path(u) -> Column:
    return F.regexp_extract(_after_netloc(_after_scheme(u)), r"^([^?#]*)", 1)


def url_query(u) -> Column:
    """Text after the first '?' and before '#', without the '?'."""
    return F.regexp_extract(_after_netloc(_after_scheme(u)), r"^[^?#]*\?([^#]*)", 1)


def is_url(u) -> Column:
    """scheme in {http, https} and a non-empty netloc."""
    return F.coalesce(url_scheme(u).isin("http", "https") & (url_netloc(u) != F.lit("")), F.lit(False))


def defrag(u) -> Column:
    """Cut '#...'."""
    return F.regexp_replace(_col(u), r"(?s)#.*$", "")


def scope_path(u) -> Column:
    """Path with trailing '/' removed (the crawl scope prefix)."""
    return F.regexp_replace(url_path(u), r"/+$", "")


def host_slug(u) -> Column:
    """netloc with '.' replaced by '_' (fallback doc_type)."""
    return F.translate(url_netloc(u), ".", "_")


def _dot_fold(segments: Column) -> Column:
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def url_join(base, href) -> Column:
    """RFC 3986 reference resolution with Python ``urljoin`` corner cases.

    * href with another scheme -> href unchanged
    * href with an authority   -> href with the scheme lower-cased
    * empty path               -> base path, href query else base query
    * otherwise                -> merged path with '.'/'..' folded; for
      path-relative hrefs empty middle segments are dropped
    An empty href yields the base; a NULL input yields NULL.
    """
    b = _col(base)
    h = _col(href)
    bs = url_scheme(b)
    b_rest = _after_netloc(_after_scheme(b))
    bn = url_netloc(b)
    bp = F.regexp_extract(b_rest, r"^([^?#]*)", 1)
    bq = F.regexp_extract(b_rest, r"^[^?#]*\?([^#]*)", 1)

    hs = url_scheme(h)
    h_rest = _after_scheme(h)
    hn = _netloc_of_rest(h_rest)
    h_tail = _after_netloc(h_rest)
    hp = F.regexp_extract(h_tail, r"^([^?#]*)", 1)
    hq = F.regexp_extract(h_tail, r"^[^?#]*\?([^#]*)", 1)

    def q(query: Column) -> Column:
        return F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))

    base_parts = F.split(bp, "/", -1)
    base_dir = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(
        base_parts
    )
    merged = F.concat(base_dir, F.split(hp, "/", -1))
    merged = F.filter(merged, lambda x, i: (i == 0) | (i == F.size(merged) - 1) | (x != ""))
    segments = F.when(hp.startswith("/"), F.split(hp, "/", -1)).otherwise(merged)
    path = F.array_join(_dot_fold(segments), "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))

    joined = (
        F.when((hs != "") & (hs != bs), h)
        .when(hn != "", F.concat(bs, F.lit("://"), hn, hp, q(hq)))
        .when(hp == "", F.concat(bs, F.lit("://"), bn, bp, q(F.when(hq != "", hq).otherwise(bq))))
        .otherwise(F.concat(bs, F.lit("://"), bn, path, q(hq)))
    )
    return F.when(h == "", b).otherwise(joined)


def file_name(p) -> Column:
    """Basename of a '/'-separated path."""
    return F.element_at(F.split(_col(p), "/"), -1)


def file_stem(p) -> Column:
    """Basename without its last suffix (a leading dot is not a suffix)."""
    return F.regexp_replace(file_name(p), r"(?<=.)\.[^.]+$", "")


def file_ext(p) -> Column:
    """Lower-cased last suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(file_name(p), r".(\.[^.]+)$", 1))


_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def with_url_join(df, base: str, href: str, out: str, parts: bool = False):
    """DataFrame form of :func:`url_join` for large link tables.

    Same result, but every URL part is a column computed once (the
    Column form re-evaluates shared sub-expressions inside the array
    lambdas), and root-relative hrefs without '.'/'..' segments -- nearly
    all real links -- skip the dot-segment fold.  With ``parts=True`` it also
    returns ``<out>_netloc``, ``<out>_path`` and ``<base>_netloc``,
    ``<base>_path`` (known per case, so the link filters need no re-parse).
    """
    b0, h = F.col(base), F.col(href)
    t = df.select("*", clean_url(b0).alias("_bc"), clean_url(h).alias("_hc"))
    bc, hc = F.col("_bc"), F.col("_hc")
    t = t.select("*", F.regexp_replace(bc, _SCHEME, "").alias("_brest0"),
                 F.regexp_replace(hc, _SCHEME, "").alias("_hrest"))
    t = t.select("*", _after_netloc(F.col("_brest0")).alias("_brest"), _after_netloc(F.col("_hrest")).alias("_htail"))
    b_rest, h_tail = F.col("_brest"), F.col("_htail")
    t = t.select(
        "*",
        F.lower(F.regexp_extract(bc, _SCHEME, 1)).alias("_bs"), _netloc_of_rest(F.col("_brest0")).alias("_bn"),
        F.regexp_extract(b_rest, r"^([^?#]*)", 1).alias("_bp"),
        F.regexp_extract(b_rest, r"^[^?#]*\?([^#]*)", 1).alias("_bq"),
        F.lower(F.regexp_extract(hc, _SCHEME, 1)).alias("_hs"), _netloc_of_rest(F.col("_hrest")).alias("_hn"),
        F.regexp_extract(h_tail, r"^([^?#]*)", 1).alias("_hp"),
        F.regexp_extract(h_tail, r"^[^?#]*\?([^#]*)", 1).alias("_hq"),
    )
    bs, bn, bp, bq, hs, hn, hp, hq = (F.col(c) for c in ("_bs", "_bn", "_bp", "_bq", "_hs", "_hn", "_hp", "_hq"))
    other_scheme = (hs != "") & (hs != bs)
    merge_case = (h != "") & ~other_scheme & (hn == "") & (hp != "")
    fast = merge_case & hp.startswith("/") & ~hp.rlike(_DOT_SEGMENT)
    t = t.withColumn("_slow", merge_case & ~fast)
    base_parts = F.split(bp, "/", -1)
    t = t.withColumn("_bdir", F.when(F.col("_slow"), F.when(F.element_at(base_parts, -1) != "", F.slice(
        base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts)))
    t = t.withColumn("_merged", F.when(F.col("_slow") & ~hp.startswith("/"),
                                       F.concat(F.col("_bdir"), F.split(hp, "/", -1))))
    t = t.withColumn("_segs", F.when(hp.startswith("/"), F.split(hp, "/", -1)).otherwise(
        F.filter(F.col("_merged"), lambda x, i: (i == 0) | (i == F.size(F.col("_merged")) - 1) | (x != ""))))
    t = t.withColumn("_fold", F.when(F.col("_slow"), _dot_fold(F.col("_segs"))))
    folded = F.array_join(F.col("_fold"), "/")
    folded = F.when(folded == "", F.lit("/")).when(folded.startswith("/"), folded).otherwise(
        F.concat(F.lit("/"), folded))
    t = t.withColumn("_path", F.when(h == "", bp).when(other_scheme, url_path(h)).when(hn != "", hp)
                     .when(hp == "", bp).when(fast, hp).otherwise(folded))
    path = F.col("_path")

    def q(query):
        return F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))

    joined = (
        F.when(h == "", b0)
        .when(other_scheme, h)
        .when(hn != "", F.concat(bs, F.lit("://"), hn, path, q(hq)))
        .when(hp == "", F.concat(bs, F.lit("://"), bn, path, q(F.when(hq != "", hq).otherwise(bq))))
        .otherwise(F.concat(bs, F.lit("://"), bn, path, q(hq)))
    )
    t = t.withColumn(out, joined)
    if parts:
        dst_netloc = F.when(h == "", bn).when(other_scheme, url_netloc(h)).when(hn != "", hn).otherwise(bn)
        t = (t.withColumn(f"{out}_netloc", dst_netloc).withColumn(f"{out}_path", path)
             .withColumn(f"{base}_netloc", bn).withColumn(f"{base}_path", bp))
    tmp = ["_bc", "_hc", "_brest0", "_hrest", "_brest", "_htail", "_bs", "_bn", "_bp", "_bq", "_hs", "_hn", "_hp",
           "_hq", "_slow", "_bdir", "_merged", "_segs", "_fold", "_path"]
    return t.drop(*tmp)
