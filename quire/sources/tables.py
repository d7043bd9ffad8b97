"""Scans of the driver tables (parquet).

Every scan names its columns so Catalyst prunes the parquet read
(``ReadSchema`` in the plan) -- the wide ``html`` / ``text`` columns are only
read by the jobs that need them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: a scan of this many splits or more (about a gigabyte) is never dealt out anew
SPREAD_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-split scan over the cluster's cores.

    A file written as one row group is read by one task, which would run
    the per-row regex / tokenizing work of a whole table single-threaded.
    When the scan has fewer than ``SPREAD_SPLITS`` partitions, and fewer than
    the default parallelism, the rows are dealt out evenly; any other input
    is returned unchanged, however many cores there are.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < min(target, SPREAD_SPLITS) else df


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, balanced: bool = False) -> DataFrame:
    """Read one driver table, projected to ``cols`` when given.  ``balanced``
    spreads an under-split scan (for CPU-heavy per-row work)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df = df.select(*cols) if cols else df
    return spread(df) if balanced else df


def pages(spark: SparkSession, sf_dir: str, with_html: bool = True) -> DataFrame:
    """SRC4 scan_pages: one row per fetched page; ``html`` only when asked
    (and then spread over the cores, see :func:`spread`)."""
    cols = ("page_id", "url", "html") if with_html else ("page_id", "url")
    return table(spark, sf_dir, "pages", *cols, balanced=with_html)
