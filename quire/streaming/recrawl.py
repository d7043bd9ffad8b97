"""Re-crawl on a page stream (ST1): features and links of pages not seen before.

Each micro-batch goes through ``foreachBatch``:

1. one pass over the pages makes slim rows (features, href values), written
   to a staging folder of the batch; ``html`` is read once and never shuffled;
2. of the pages with one url the smallest id stays, unless the url is in the
   state: a table ``(url, page_id)`` in buckets of the url, partitioned by day and
   batch.  The batch's urls are shuffled to the buckets, the state is read where
   it lies; with ``forget_days`` only the days that count are read, so a page is
   taken again when its last visit is older, and the state that a run reads does
   not grow beyond them;
3. the new urls, the features and the links of their pages are written, each to
   a folder of the batch that a repeated batch overwrites.  A batch ignores its
   own entry in the state, so a batch that is run again after a failure finds the
   same pages: both sinks hold every page exactly once.

``availableNow`` drains what has arrived and stops; the next scheduled run goes on
where the checkpoint ends.  Pages without a url are left out.  The number of
buckets must stay the same over the runs of one state.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions.dates import parse_registry_time
from quire.operators.classify import page_features
from quire.operators.links import resolve_links

PAGE_SCHEMA = "page_id long, url string, html string"


class SeenUrls:
    """The state: urls by the day and the batch in which they were taken."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.name = spark, path, "quire_seen_" + hashlib.md5(path.encode()).hexdigest()[:12]
        schema = "url STRING, page_id BIGINT, day DATE, batch BIGINT"
        spark.createDataFrame([], schema).write.mode("append").partitionBy("day", "batch").parquet(path)  # the first run: makes the folder
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet "
                  f"PARTITIONED BY (day, batch) CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")  # of earlier sessions

    def new(self, pages: DataFrame, batch: int, since: str | None) -> DataFrame:
        """(url, page_id): the urls of the batch that the state doesn't hold."""
        known = self.spark.table(self.name).where(F.col("batch") != batch)
        if since is not None:
            known = known.where(F.col("day") > F.lit(since).cast("date"))
        first = pages.where("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id"))
        return first.join(known.select("url"), "url", "left_anti")

    def put(self, urls: DataFrame, batch: int, day: str) -> DataFrame:
        """Write the batch's entry, in place of an earlier try; returns it."""
        fresh = f"{self.path}-new/batch={batch}"  # a table that is read can't be overwritten
        urls.select("url", "page_id").write.mode("overwrite").parquet(fresh)
        urls = self.spark.read.parquet(fresh)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            urls.select("url", "page_id", F.lit(day).cast("date").alias("day"), F.lit(batch).cast("long").alias("batch")).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return self.spark.table(self.name).where((F.col("day") == F.lit(day).cast("date")) & (F.col("batch") == batch)).select("url", "page_id")

    def close(self) -> None:
        """Remove the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def process_batch(pages: DataFrame, batch: int, seen: SeenUrls, out_path: str, day: str, since: str | None, scope: str = "site") -> None:
    """One micro-batch of pages(page_id, url, html) into the sinks and the state."""
    spark = pages.sparkSession
    staged = os.path.join(out_path, "staging", f"batch={batch}")
    page_features(pages, url=F.col("url"), hrefs=H.href_values(F.col("html"))).write.mode("overwrite").parquet(staged)
    slim = spark.read.parquet(staged)
    kept = seen.put(seen.new(slim.select("url", "page_id"), batch, since), batch, day)
    mine = slim.join(kept, ["url", "page_id"], "left_semi")
    mine.drop("hrefs").write.mode("overwrite").parquet(os.path.join(out_path, "features", f"batch={batch}"))
    hrefs = mine.select(F.col("url").alias("src"), F.explode("hrefs").alias("href"))
    resolve_links(hrefs, scope).write.mode("overwrite").parquet(os.path.join(out_path, "links", f"batch={batch}"))


def run_recrawl(spark: SparkSession, source_dir: str, out_path: str, now: str, forget_days: int | None = None,
                max_files_per_trigger: int | None = None, buckets: int | None = None) -> None:
    """Take what has arrived in ``source_dir`` (parquet files of pages, in any
    subfolder) since the last run.  ``now``: registry time of the run."""
    day, since = (None if d is None else str(d) for d in spark.range(1).select(
        F.to_date(parse_registry_time(F.lit(now))),
        F.date_sub(F.to_date(parse_registry_time(F.lit(now))), forget_days) if forget_days is not None else F.lit(None).cast("date")).first())
    if day is None:
        raise ValueError(f"no registry time: {now!r}")
    seen = SeenUrls(spark, os.path.join(out_path, "seen"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    reader = spark.readStream.schema(PAGE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    try:
        query = (reader.parquet(source_dir).writeStream.foreachBatch(lambda pages, batch: process_batch(pages, batch, seen, out_path, day, since))
                 .option("checkpointLocation", os.path.join(out_path, "checkpoint")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        seen.close()


def read_sinks(spark: SparkSession, out_path: str) -> tuple[DataFrame, DataFrame]:
    """(features with url, links) of all batches."""
    return tuple(spark.read.parquet(os.path.join(out_path, name)).drop("batch") for name in ("features", "links"))
