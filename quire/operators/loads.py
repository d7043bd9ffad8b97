"""Committed loads (SNK5-SNK7 with SNK2): document rows and registry rows as one.

A load writes the rows of its documents and the registry rows of its stores to a
staging folder and publishes both by one rename to ``loads/load=<id>``.  A reader
sees all of a load or nothing; a load that fails leaves the registry as it was,
and one that is repeated finds its folder and changes nothing, as the store ids
follow from the batch.  (The rename is atomic on HDFS and local disks; an object
store needs a table format's commit instead.)
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORES = "doc_type string, rag_id string, description string, created_at string, pos bigint"
DOCUMENTS = "store_id string, batch_id string, pos bigint, file_path string"


def commit_load(base: str, load_id: str, stores: DataFrame, documents: DataFrame, now: str) -> bool:
    """Publish stores(doc_type, store_id, description) and documents(store_id,
    batch_id, pos, file_path) as load ``load_id``, created at ``now``.  False if
    that load is published already.

    ``pos`` of the stores rises along their order by (doc_type, store_id); stores
    without a doc_type or an id are not registered."""
    spark = stores.sparkSession
    target = f"{base}/loads/load={load_id}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop.Path(target)):
        return False
    staged = f"{base}/staged/{load_id}-{uuid.uuid4().hex}"
    entries = (stores.where((F.coalesce("doc_type", F.lit("")) != "") & (F.coalesce("store_id", F.lit("")) != "")).orderBy("doc_type", "store_id")
               .select("doc_type", F.col("store_id").alias("rag_id"), F.nullif("description", F.lit("")).alias("description"),
                       F.lit(now).alias("created_at"), F.monotonically_increasing_id().alias("pos")))
    entries.write.parquet(f"{staged}/stores")
    documents.select("store_id", F.col("batch_id").cast("string").alias("batch_id"), F.col("pos").cast("bigint").alias("pos"), "file_path").write.parquet(
        f"{staged}/documents")
    fs.mkdirs(hadoop.Path(f"{base}/loads"))
    if not fs.rename(hadoop.Path(staged), hadoop.Path(target)):
        raise OSError(f"load {load_id} could not be published")
    return True


def _read(spark: SparkSession, base: str, what: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema + ", load string").option("basePath", f"{base}/loads").parquet(f"{base}/loads/*/{what}")
    except AnalysisException:  # no load yet
        return spark.createDataFrame([], schema + ", load string")


def read_registry(spark: SparkSession, base: str) -> DataFrame:
    """Registry rows of all published loads, with their ``load``.  Two loads of
    one second may have equal ``pos``; ``latest_store`` then goes by the id."""
    return _read(spark, base, "stores", STORES)


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """Document rows of all published loads, with their ``load``."""
    return _read(spark, base, "documents", DOCUMENTS)
