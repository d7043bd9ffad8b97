"""The whole ingest on a small page table."""
from quire.plans.ingest import crawl_to_bundles, page_facts, write_facts

from .conftest import SF_SMALL, exchange_children, formatted
from .test_plans import exchange_inputs

REG = "pos int, keyword string, name string, url string, description string"


def test_crawl_to_bundles(spark, tmp_path):
    pages = spark.createDataFrame([
        (1, "https://d.example/docs", '<h1>Home</h1><a href="/docs/a">a</a><a href="/docs/missing">m</a>'),
        (2, "https://d.example/docs/a", '<p>Page A</p><a href="/docs/a/b">b</a>'),
        (3, "https://d.example/docs/a/b", '<div id="root"></div><script>' + "x" * 900 + "</script>"),
        (4, "https://other.example/", "<p>other</p>"),
    ], "page_id long, url string, html string")
    renders = spark.createDataFrame([("https://d.example/docs/a/b", 200, True, "# Rendered B", None)],
                                    "url string, status int, success boolean, markdown string, error string")
    registry = spark.createDataFrame([(0, "Docs", "Docs", "https://d.example/docs", None)], REG)
    requests = spark.createDataFrame([(1, "docs"), (2, "https://d.example/docs"), (3, "nothing")],
                                     "req_id int, keyword_or_url string")
    out = crawl_to_bundles(pages, registry, requests, "2025/11/20 12:00:00", max_depth=3,
                           renders=renders, out_path=str(tmp_path / "b"))
    s = {r.doc_type: r for r in out["summary"].collect()}
    assert list(s) == ["Docs"]
    assert (s["Docs"].page_count, s["Docs"].failed_urls, s["Docs"].max_depth_reached) == (3, 1, 2)
    blocks = {r.url: r for r in out["blocks"].collect()}
    assert blocks["https://d.example/docs"].is_first and "Home" in blocks["https://d.example/docs"].block
    assert "# Rendered B" in blocks["https://d.example/docs/a/b"].block
    assert {r.url for r in out["failed"].collect()} == {"https://d.example/docs/missing"}
    res = {r.req_id: r.tier for r in out["resolved"].collect()}
    assert res == {1: "case_insensitive", 2: "url", 3: "not_found"}


def test_html_is_read_once_and_stays(spark):
    """The facts are shuffled without the html, and joined where their buckets lie."""
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    plan = page_facts(pages).repartition(4, "url")
    moved = exchange_inputs(plan)
    assert moved and not any("html#" in cols for cols in moved)
    assert formatted(plan).count("Scan parquet") == 2  # once in the tree, once in the details
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    name, _ = write_facts(pages)
    try:
        urls = spark.table(name).select("url").distinct()
        joined = spark.range(5).selectExpr("cast(id as string) as url").join(spark.table(name).groupBy("url").count(), "url")
        for df in (urls, joined):
            assert not any("quire_page_facts" in scan for scan in exchange_children(spark, df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_first_row_of_a_url_counts(spark):
    pages = spark.createDataFrame([(7, "https://d.example/", "<p>second</p>"), (2, "https://d.example/", "<p>first</p>")],
                                  "page_id long, url string, html string")
    registry = spark.createDataFrame([(0, "Docs", "Docs", "https://d.example/", None)], REG)
    out = crawl_to_bundles(pages, registry, spark.createDataFrame([(1, "docs")], "req_id int, keyword_or_url string"), "2025/11/20 12:00:00")
    assert [r.block.split("\n\n")[2] for r in out["blocks"].collect()] == ["first"]
    assert out["failed"].count() == 0
