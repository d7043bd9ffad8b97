"""URL expressions vs Python's urllib / pathlib semantics."""
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import urls as U

BASES = ["https://example.com/", "https://example.com/docs/", "https://example.com/docs",
         "http://Ex.com:8080/a/b/c?x=1", "https://example.com", "https://h.org/a//b/"]
SEG = st.sampled_from(["a", "b", "..", ".", "", "x.html", "docs", "%41"])
HREF = st.builds(lambda lead, segs, q: lead + "/".join(segs) + q,
                 st.sampled_from(["", "/", "//other.org/", "./", "../", "https://example.com/", "http:", "mailto:"]),
                 st.lists(SEG, min_size=0, max_size=5), st.sampled_from(["", "?", "?k=v"]))


def test_url_join_fixed_cases(spark):
    cases = [("https://example.com/docs/", "page2"), ("https://example.com/docs/", "../other/page3"),
             ("https://example.com/", "page1"), ("https://example.com/docs", "/docs2/x"),
             ("https://example.com/a/b", "?q=1"), ("https://example.com/a/b?z", ""),
             ("https://example.com/", "//cdn.example.com/x"), ("https://example.com/", "ftp://f/x"),
             ("https://example.com/a/", "../../../../up"), ("https://example.com/a/b/", "./")]
    df = spark.createDataFrame(cases, "b string, h string")
    got = {(r.b, r.h): r.j for r in df.select("b", "h", U.url_join("b", "h").alias("j")).collect()}
    staged = {(r.b, r.h): r.j for r in U.with_url_join(df, "b", "h", "j").collect()}
    for b, h in cases:
        assert got[(b, h)] == urljoin(b, h) == staged[(b, h)], (b, h)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BASES), HREF), min_size=1, max_size=40))
def test_url_join_matches_urllib(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", U.url_join("b", "h").alias("j")).collect():
        assert r.j == urljoin(r.b, r.h), (r.b, r.h)
    for r in U.with_url_join(df, "b", "h", "j").collect():
        assert r.j == urljoin(r.b, r.h), (r.b, r.h)


def test_url_parts_and_is_url(spark):
    urls = ["https://Docs.Example.com:8443/a/b/?q=1#frag", "HTTP://x.org", "ftp://x.org/a", "example.com/a",
            "https://", "http://h/a.tar.gz", "not a url", "https://h/.bashrc"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    out = df.select("u", U.is_url("u").alias("is_url"), U.url_scheme("u").alias("s"), U.url_netloc("u").alias("n"),
                    U.url_path("u").alias("p"), U.url_query("u").alias("q"), U.scope_path("u").alias("sp"),
                    U.host_slug("u").alias("slug"), U.defrag("u").alias("d")).collect()
    for r in out:
        p = urlparse(r.u)
        assert r.is_url == (p.scheme in ("http", "https") and bool(p.netloc)), r.u
        assert (r.s, r.n, r.p, r.q) == (p.scheme, p.netloc, p.path, p.query), r.u
        assert r.sp == p.path.rstrip("/")
        assert r.slug == p.netloc.replace(".", "_")
        assert r.d == r.u.split("#")[0]


def test_file_name_stem_ext(spark):
    paths = ["/a/b/file.TXT", "/a/.bashrc", "/a/x.tar.gz", "C++.txt", "/a/noext", "/a/trail.", "/a/b.c/d"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", U.file_name("p").alias("n"), U.file_stem("p").alias("s"), U.file_ext("p").alias("e")).collect():
        pp = PurePosixPath(r.p)
        assert (r.n, r.s, r.e) == (pp.name, pp.stem, pp.suffix.lower()), r.p


def test_null_inputs_stay_null(spark):
    df = spark.createDataFrame([(None, None)], "b string, h string")
    r = df.select(U.url_join("b", "h").alias("j"), U.url_netloc("b").alias("n")).first()
    assert r.j is None and r.n is None
    assert df.select(U.is_url("b").alias("x")).first().x is False


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab.Z_ -", min_size=1, max_size=12), min_size=1, max_size=20))
def test_file_parts_match_pathlib(spark, names):
    paths = [f"/d/{n}" for n in names if n not in (".", "..") and n.strip(".") != "" or n == "a"]
    if not paths:
        return
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", U.file_name("p").alias("n"), U.file_stem("p").alias("s"), U.file_ext("p").alias("e")).collect():
        pp = PurePosixPath(r.p)
        assert (r.n, r.s, r.e) == (pp.name, pp.stem, pp.suffix.lower()), r.p
