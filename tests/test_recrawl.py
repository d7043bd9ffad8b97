"""ST1: the re-crawl stream, its state and its repeated batches."""
import pytest

from quire.operators.links import extract_links
from quire.streaming import recrawl as R

from .conftest import exchange_children, rows

HTML = '<a href="/next">n</a><a href="/next">again</a><a href="https://other.example/x">o</a>'


def arrive(spark, folder, pages):
    spark.createDataFrame([(i, u, h) for i, u, h in pages], R.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def taken(spark, out):
    return sorted(r.page_id for r in R.read_sinks(spark, out)[0].collect())


def test_runs_and_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, src, [(3, "https://h/a", HTML), (1, "https://h/a", "<p>same"), (2, "https://h/b", HTML), (9, None, HTML)])
    R.run_recrawl(spark, src, out, "2024/02/01 09:00:00")
    assert taken(spark, out) == [1, 2]
    arrive(spark, src, [(4, "https://h/a", HTML), (5, "https://h/c", HTML)])
    R.run_recrawl(spark, src, out, "2024/02/08 09:00:00")
    assert taken(spark, out) == [1, 2, 5]
    R.run_recrawl(spark, src, out, "2024/02/09 09:00:00")  # nothing has arrived
    assert taken(spark, out) == [1, 2, 5]
    links = R.read_sinks(spark, out)[1]
    pages = spark.createDataFrame([("https://h/b", HTML), ("https://h/c", HTML)], "url string, html string")
    assert rows(links, "src", "dst") == rows(extract_links(pages, scope="site"))
    assert not [t for t in spark.catalog.listTables() if "seen" in t.name]


def test_forgotten_urls_are_taken_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for page, day in ((1, "01"), (2, "05"), (3, "08"), (4, "10")):
        arrive(spark, src, [(page, "https://h/a", HTML)])
        R.run_recrawl(spark, src, out, f"2024/02/{day} 09:00:00", forget_days=7)
    assert taken(spark, out) == [1, 3]


@pytest.mark.parametrize("done", ["state", "features", "all"])
def test_repeated_batch(spark, tmp_path, monkeypatch, done):
    """A batch that fails after one of its writes is run again and changes nothing twice."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, src, [(1, "https://h/a", HTML)])
    R.run_recrawl(spark, src, out, "2024/02/01 09:00:00")
    arrive(spark, src, [(2, "https://h/a", HTML), (3, "https://h/b", HTML)])
    whole = R.process_batch

    def failing(pages, batch, seen, *args, **kw):
        if done == "state":
            seen.put(seen.new(pages, batch, None), batch, "2024-02-01")
        else:
            whole(pages, batch, seen, *args, **kw)
        raise RuntimeError("lost")

    def half(hrefs, scope):
        raise RuntimeError("lost")

    if done == "features":
        monkeypatch.setattr(R, "resolve_links", half)
    else:
        monkeypatch.setattr(R, "process_batch", failing)
    with pytest.raises(Exception, match="lost"):
        R.run_recrawl(spark, src, out, "2024/02/01 09:00:00")
    monkeypatch.undo()
    R.run_recrawl(spark, src, out, "2024/02/01 09:00:00")
    features, links = R.read_sinks(spark, out)
    assert sorted(r.page_id for r in features.collect()) == [1, 3]
    assert rows(links) == [("https://h/a", "https://h/next"), ("https://h/b", "https://h/next")]


def test_state_is_not_shuffled(spark, tmp_path):
    seen = R.SeenUrls(spark, str(tmp_path / "seen"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        pages = spark.createDataFrame([(1, "https://h/a")], "page_id long, url string")
        assert rows(seen.put(seen.new(pages, 0, None), 0, "2024-02-01")) == [("https://h/a", 1)]
        new = seen.new(pages.unionByName(spark.createDataFrame([(2, "https://h/b")], pages.schema)), 1, None)
        assert rows(new) == [("https://h/b", 2)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        new = seen.new(pages, 1, None)
        assert not any("quire_seen" in scan for scan in exchange_children(spark, new))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        seen.close()
