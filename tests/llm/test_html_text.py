"""Op 5: the driver's pages against a plain reading of their article, and hand-made pages."""
import html
import random
import re
import time

import pytest

from quire.llm import html_text as H

from ..conftest import SF_MID

LONG = "Many plain words that tell a story, one after the other, until the paragraph is over and done."


def article(page):
    """The driver's pages: blocks of the article element."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_whole_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    out = H.op5_html_text(spark, SF_MID).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == article(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a &lt; b &amp; c&nbsp;d<br>e", "a < b & c d e"), ("1 < 2 <3 </ >x", "1 < 2 <3 x"),
    ("<article><h1>T</h1><p>x<p>y</article><footer>f</footer>", "T\nx\ny"),
    ("<article><p>a</p><div class='ad-box'>buy</div><p>b</p><section id=comments><article class=comment>c</article></section></article>", "a\nb"),
    ("<div class=notice>cookies<article><p>in</p></article>", "in"),
    ("<header><h1>site</h1></header><article><header><h1>title</h1></header><p>x</p></article>", "title\nx"),
    ("<article><p>a<script>if (a < b) '</p>'</script>b</p><style>p{}</style><!-- <p>no</p> --></article>", "ab"),
    ("<main><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></main><aside>no</aside>", "one\ntwo\n1\n2"),
    ("<p title='a > b'>x</p><form><p>name</p></form>", "x"),
    ("<ARTICLE><P>Up &#233; &#x1D4B3;</P></ARTICLE>", "Up é 𝒳"),
    ("<article><p>a</p><!-- open", "a"), ("<article>x<a href='", "x"), ("<article><script>x", ""),
    ("<article><p>see <a href=x>this</a> and <b>that</b></p></article>", "see this and that"),
])
def test_small_pages(page, text):
    assert H.main_text(page) == text


def test_distribution_without_article():
    page = (f"<body><div class=top><a href=a>Home</a> <a href=b>About</a></div><nav><a>x</a></nav><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
            "<div class=sidebar>Latest</div><div>Imprint</div><footer>© 2020</footer></body>")
    assert H.main_text(page) == f"{LONG}\nShort.\n{LONG}"
    assert H.segments([0, 5, 0, 0, 0, 9, 9, 0], 2) == [(0, 2, 5), (4, 7, 18)]


def test_whole_table_without_article_tags(spark):
    for r in spark.read.parquet(f"{SF_MID}/pages.parquet").select("html").collect():
        for name in ("div", "section"):
            page = r.html.replace("<article>", f"<{name}>").replace("</article>", f"</{name}>")
            assert H.main_text(page) == article(r.html)


def test_every_page_goes_through_the_sums(monkeypatch):
    calls = []
    whole = H.segments
    monkeypatch.setattr(H, "segments", lambda *a: calls.append(a) or whole(*a))
    H.main_text(f"<article><p>{LONG}</p></article>")
    assert len(calls) == 1


@pytest.mark.parametrize("page,text", [
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Read on</p></article>", f"{LONG}\n{LONG}"),  # a teaser
    (f"<div><p>{LONG}</p></div><article><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div>Imprint</div>", LONG),
    (f"<article class='hentry category-social'><p>{LONG}</p></article>", LONG),
    (f"<main><article class='comments-open'><p>{LONG}</p><div class=ad>x</div><p>End.</p></article></main>", f"{LONG}\nEnd."),
    (f"<div class=notice>cookies<article class='content no-sidebar'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p></article><div id=comments><article class=comment-body><p>{LONG}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article>", LONG),
    (f"<div class='page comments-open'><article><p>{LONG}</p></article></div>", LONG),
])
def test_articles_are_hints(page, text):
    assert H.main_text(page) == text


def test_long_and_broken_pages_are_linear():
    n = 200_000
    start = time.time()
    for page in ["<" * n, "<a " * n, "<a \"" * n, "<!--" * n, "<script>" * n, "<p>" * n, "</p>" * n, " " * n + "x", "&" * n, "<a '" + "x" * n, "<div class='" + "ad " * n,
                 "<p " + "class " * n + ">x", "<!" * n, "<title>" * n]:
        H.main_text(page)
    assert time.time() - start < 60


def test_edges(spark):
    rows = [(1, None, None), (None, "u", "<article>x</article>"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted(map(tuple, H.extract(df).collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert H.extract(df.limit(0)).collect() == []


def test_random_markup_never_fails():
    rnd = random.Random(1)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "text ", "<a href='x'>", "</a>", "<!--", "-->", "<script>", "</script>", "\"", "'", ">", "<", "&amp;"]
    for _ in range(500):
        assert isinstance(H.main_text("".join(rnd.choice(parts) for _ in range(40))), str)
