"""ST1: the streaming classification equals the batch job."""
from quire.operators.classify import page_features
from quire.sources.tables import pages
from quire.streaming.ingest import page_features_stream_run

from .conftest import SF_SMALL, rows


def test_stream_equals_batch(spark, tmp_path):
    streamed = page_features_stream_run(spark, SF_SMALL, out_path=str(tmp_path / "run"))
    batch = page_features(pages(spark, SF_SMALL))
    assert rows(streamed, *batch.columns) == rows(batch)


def test_stream_dedups_urls_across_batches(spark, tmp_path):
    """Two page files arrive in separate micro-batches; a URL seen in the
    first is not classified again (state kept in the checkpoint)."""
    from quire.streaming.ingest import classify_stream, page_stream, run_available_now

    src = tmp_path / "in"
    src.mkdir()
    a = spark.createDataFrame([(1, "https://h/a", "<p>a</p>"), (2, "https://h/b", "<p>b</p>")],
                              "page_id long, url string, html string")
    b = spark.createDataFrame([(3, "https://h/a", "<p>again</p>"), (4, "https://h/c", "<p>c</p>")],
                              "page_id long, url string, html string")
    a.coalesce(1).write.parquet(str(src / "one"))
    b.coalesce(1).write.parquet(str(src / "two"))
    stream = (spark.readStream.schema(a.schema).option("maxFilesPerTrigger", "1")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(src)))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_available_now(classify_stream(stream, dedup_urls=True), out, ckpt)
    got = sorted(r.page_id for r in spark.read.parquet(out).collect())
    assert len(got) == 3 and {2, 4} <= set(got)


def test_table_of_part_files(spark, tmp_path):
    """Larger tables are folders of part files; an empty one gives no rows."""
    own = [(i, f"https://h{i % 3}/p{i}", f"<div id='root'>{i}</div>") for i in range(20)]
    p = spark.createDataFrame(own, "page_id long, url string, html string")
    p.repartition(4).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    streamed = page_features_stream_run(spark, str(tmp_path / "many"), out_path=str(tmp_path / "run"))
    assert rows(streamed, *page_features(p).columns) == rows(page_features(p))
    p.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert page_features_stream_run(spark, str(tmp_path / "none"), out_path=str(tmp_path / "run0")).count() == 0
