"""Incremental ingest (ST1): the stateless page jobs on a page stream.

The original has no streaming engine; its nearest need is the periodic
re-crawl.  Here new page files landing in a directory are classified as they
arrive: ``readStream`` over a pattern of paths in the directory (a table there
may be one file or a folder of part files), the same Column expressions as the batch job, and an exactly-once
file sink with a checkpoint in the shared folder.  ``availableNow`` drains
what is there and stops, so a scheduled run processes only the new files
since the last one; a lost executor replays from the checkpoint.

Optional visited-URL de-duplication uses ``dropDuplicates(["url"])``: its
state (one key per distinct url) lives in the state store and is spilled to
the checkpoint, never collected.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quire.operators.classify import page_features
from quire.session import scratch_path


def page_stream(spark: SparkSession, source_dir: str, glob: str = "pages.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(os.path.join(source_dir, glob)).select("page_id", "url", "html").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # a plain path must be a folder; as a pattern it may be a file, or a folder of part files
    return reader.parquet(os.path.join(source_dir, glob if any(c in glob for c in "*?[{") else "{" + glob + "}"))


def classify_stream(pages: DataFrame, dedup_urls: bool = False) -> DataFrame:
    src = pages.dropDuplicates(["url"]) if dedup_urls else pages
    return page_features(src)


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def page_features_stream_run(spark: SparkSession, sf_dir: str, out_path: str | None = None) -> DataFrame:
    """Run the classification stream over ``sf_dir`` until it is drained and
    return the sink as a batch DataFrame."""
    base = out_path or scratch_path(spark, "stream-page-features")
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "_checkpoint")
    features = classify_stream(page_stream(spark, sf_dir))
    run_available_now(features, out, ckpt)
    return spark.read.schema(features.schema).parquet(out)
