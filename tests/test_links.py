"""G1 link extraction: fixture cases of the crawler's link rules."""
from quire.operators.links import extract_links


def links(spark, base, hrefs, scope="page"):
    html = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    df = spark.createDataFrame([(base, html)], "url string, html string")
    return sorted(r.dst for r in extract_links(df, scope=scope).collect())


def test_absolute_same_domain(spark):
    assert links(spark, "https://example.com/", ["https://example.com/page1", "https://example.com/page2"]) == [
        "https://example.com/page1", "https://example.com/page2"]


def test_relative_and_parent_scope(spark):
    got = links(spark, "https://example.com/docs/", ["/docs/page1", "page2", "../other/page3"])
    assert got == ["https://example.com/docs/page1", "https://example.com/docs/page2"]


def test_fragments_removed_and_deduplicated(spark):
    assert links(spark, "https://example.com/", ["page1#section1", "page1#section2"]) == ["https://example.com/page1"]


def test_other_domain_dropped(spark):
    got = links(spark, "https://example.com/", ["/a", "https://other.com/b", "/c"])
    assert got == ["https://example.com/a", "https://example.com/c"]


def test_empty_and_hash_only(spark):
    assert links(spark, "https://example.com/", ["", "page1", "#"]) == ["https://example.com/page1"]


def test_no_links(spark):
    df = spark.createDataFrame([("https://example.com/", "<p>none</p>")], "url string, html string")
    assert extract_links(df).count() == 0


def test_duplicates(spark):
    assert links(spark, "https://example.com/", ["page1", "page1", "page2"]) == [
        "https://example.com/page1", "https://example.com/page2"]


def test_prefix_not_segment_aware(spark):
    assert links(spark, "https://example.com/docs", ["/docs2/x"]) == ["https://example.com/docs2/x"]


def test_scheme_not_compared_port_is(spark):
    got = links(spark, "https://example.com/", ["http://example.com/x", "https://example.com:8443/y"])
    assert got == ["http://example.com/x"]


def test_site_scope_keeps_parent_links(spark):
    got = links(spark, "https://example.com/docs/", ["../other/page3"], scope="site")
    assert got == ["https://example.com/other/page3"]
