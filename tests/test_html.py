"""Visible text, text ratio, frameworks, dynamic flag, hrefs."""
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.operators.classify import page_features, site_render_needs

from .conftest import SF_SMALL


class _Ref(HTMLParser):
    """Stdlib reference: stripped text nodes outside script/style, hrefs of <a>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.hrefs = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a":
            for k, v in attrs:
                if k == "href" and v is not None:
                    self.hrefs.append(v)
                    break

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, d):
        if not self.skip and d.strip():
            self.out.append(d.strip())


def ref(html):
    p = _Ref()
    p.feed(html)
    p.close()
    return "".join(p.out), p.hrefs


CASES = {
    "react": ('<html><head><script src="x.js"></script></head><body><div id="root"></div></body></html>', ["React"]),
    "vue": ('<ul class=menu><li v-for="dish in dishes" :key="dish.id">soup</li></ul>', ["Vue"]),
    "angular": ('<html ng-app="a"><div ng-controller="C"></div></html>', ["Angular"]),
    "next": ('<main>Prices</main><link rel=preload href="/shop/_next/static/css/7.css">', ["Next.js"]),
    "nuxt": ('<p>Timetable</p><script>(function(w){w.__NUXT__=[7]})(window)</script>', ["Nuxt"]),
    "plain": ("<html><body><h1>API</h1><p>Reference &amp; guide.</p></body></html>", []),
    "empty": ("", []),
    "bare": ("<html><body></body></html>", []),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_frameworks_and_text(spark, name):
    html, fw = CASES[name]
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(H.detect_frameworks("h").alias("fw"), H.visible_text("h").alias("t"),
                  H.text_ratio("h").alias("ratio")).first()
    assert r.fw == fw
    assert r.t == ref(html)[0]
    if html == "":
        assert r.ratio == 0.0


def test_dynamic_needs_framework_and_low_ratio(spark):
    long_text = "<p>" + "word " * 300 + "</p>"
    pages = [(1, "https://a/1", '<div id="root"></div><script>' + "x" * 900 + "</script>"),
             (2, "https://a/2", '<div id="root"></div>' + long_text * 3),
             (3, "https://a/3", "<p>static</p><script>" + "x" * 900 + "</script>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.frameworks, r.is_dynamic) for r in page_features(df).collect()}
    assert got == {1: ("React", True), 2: ("React", False), 3: ("", False)}


# One page per pattern, each hit by that pattern alone.
OWN_MARKUP = {
    "React": ["<div class='x' id='root'>", "<p data-reactroot>", "<i data-react-checksum=3>"],
    "Vue": ["<div lang=en id=\"app\">", "<b v-cloak>", "<li v-if=open>", "<li v-for='q in qs'>"],
    "Angular": ["<body ng-app>", "<form ng-controller=Edit>", "<input NG-MODEL=name>"],
    "Next.js": ["self.__NEXT_DATA__ = 1", "<link href=/a/_next/static/c.css>"],
    "Nuxt": ["__NUXT__"],
}


def test_dynamic_means_a_framework_and_little_text(spark):
    """Around the threshold: n letters of text in a page of 10 n + d characters."""
    rows, want = [], []
    for name, marks in OWN_MARKUP.items():
        for mark in marks:
            for letters, d in ((0, 40), (30, -9), (30, 0), (30, 9), (400, -1), (400, 1)):
                shell = f"<style>{mark}</style><p>{'é' * letters}</p><!---->"
                fill = max(0, 10 * letters + d - len(shell))
                page = shell.replace("<!---->", "<!--" + "." * fill + "-->")
                rows.append((len(rows), "https://h/p", page))
                want.append((name, letters / len(page) < 0.1))
    out = page_features(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.frameworks, r.is_dynamic) for r in out] == want


def test_visible_text_and_hrefs_equal_stdlib_on_driver_pages(spark):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    for r in df.select("html", H.visible_text("html").alias("t"), H.href_values("html").alias("h")).collect():
        t, hrefs = ref(r.html)
        assert r.t == t
        assert list(r.h) == hrefs


def test_href_edge_cases(spark):
    html = ("<a href='/single'>s</a><A HREF=/bare>b</A><a data-href=\"/no\">n</a><abbr href='/no2'>x</abbr>"
            "<!-- <a href=\"/commented\"> --><a title=\"x>y\" href=\"/after-gt\">g</a>"
            "<script>var s='<a href=\"/inscript\">';</script><a href=\"/amp?a=1&amp;b=2\">e</a>")
    got = spark.createDataFrame([(html,)], "h string").select(H.href_values("h").alias("h")).first().h
    assert list(got) == ref(html)[1]


def test_site_render_needs_counts(spark):
    pages = [(1, "https://a.org/1", '<div id="root"></div><script>' + "x" * 900 + "</script>"),
             (2, "https://a.org/2", "<p>hello</p>"), (3, "http://b.org/x", "<p>b</p>")]
    out = {r.host: r for r in site_render_needs(page_features(
        spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    assert (out["a.org"].n_pages, out["a.org"].n_dynamic, out["a.org"].n_static) == (2, 1, 1)
    assert (out["b.org"].n_pages, out["b.org"].n_dynamic) == (1, 0)


def test_text_nodes_around_removed_script_are_stripped_separately(spark):
    html = "<p>text1 <script>x()</script> text2 <!-- c --> text3</p>  tail &nbsp;"
    got = spark.createDataFrame([(html,)], "h string").select(H.visible_text("h").alias("t")).first().t
    assert got == ref(html)[0] == "text1text2text3tail"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_PIECES = ["word", "x y", " ", "\n", "\t", "<p>", "</p>", "<b>", "</b>", "<br>", '<div class="c">', "</div>",
           "&amp;", "&lt;", "&nbsp;", "&copy;", "&quot;", "<!-- note -->", "<script>var a = 1;</script>",
           "<style>.c{}</style>", '<a href="/x">', "</a>", "<title>T</title>", "é"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES), min_size=0, max_size=25), min_size=1, max_size=8))
def test_visible_text_matches_stdlib_on_generated_html(spark, docs):
    htmls = ["".join(d) for d in docs]
    df = spark.createDataFrame([(h,) for h in htmls], "h string")
    got = [r.t for r in df.select(H.visible_text("h").alias("t")).collect()]
    assert got == [ref(h)[0] for h in htmls]


_LINKS = ['<a href="/a">', "<a href='/b?x=1&amp;y=2'>", "<a href=/c>", '<A HREF="/D">', "<a>", "</a>",
          '<a title="t" href="/e#f">', '<abbr href="/no">', "<!-- <a href='/hidden'> -->",
          "<script>'<a href=\"/s\">'</script>", "text", " "]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_LINKS), min_size=0, max_size=15), min_size=1, max_size=8))
def test_href_values_match_stdlib_on_generated_html(spark, docs):
    htmls = ["".join(d) for d in docs]
    df = spark.createDataFrame([(h,) for h in htmls], "h string")
    got = [list(r.h) for r in df.select(H.href_values("h").alias("h")).collect()]
    assert got == [ref(h)[1] for h in htmls]


MEGA = 1_000_000
RUNS = {
    "blanks": ("<p>a" + " " * MEGA + "b</p>", MEGA + 2, []),
    "lines": ("<p>" + "\n " * (MEGA // 2) + "</p>x", 1, []),
    "nbsp": ("<b>" + "&nbsp;" * (MEGA // 6) + "</b>y", 1, []),
    "open_a": ("<a " + "x" * MEGA, MEGA + 3, []),
    "many_a": ("<a " * (MEGA // 3), MEGA // 3 * 3 - 1, []),
    "attribute": ("<a title='" + "x" * MEGA + "' href=/z>t</a>", 1, ["/z"]),
    "quotes": ("<a '" * (MEGA // 4), MEGA, []),
    "less": ("<" * MEGA, MEGA, []),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_megabyte_runs_are_linear(spark, name):
    page, n_text, hrefs = RUNS[name]
    start = time.time()
    row = spark.createDataFrame([(page,)], "h string").select(
        F.length(H.visible_text("h")).alias("n"), H.href_values("h").alias("hrefs")).collect()[0]
    assert (row.n, row.hrefs) == (n_text, hrefs) and time.time() - start < 60


def test_no_html_counts_as_static(spark):
    rows = spark.createDataFrame([(1, "https://h/a", None), (2, "https://h/b", "")], "page_id int, url string, html string")
    got = {r.page_id: (r.text_ratio, r.is_dynamic) for r in page_features(rows).collect()}
    assert got == {1: (1.0, False), 2: (0.0, False)}
    assert [r[0] for r in rows.orderBy("page_id").select(H.text_ratio("html")).collect()] == [1.0, 0.0]
