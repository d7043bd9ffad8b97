"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark
decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's docs.
All but the last return the columns of ``documents``.  Rows are identified by
``doc_id``; a null id is never dropped by another document's verdict, and rows
with one id share their fate.  Null, empty and very long texts, repeated rows,
empty tables and extra columns: as in the operators' docstrings; extra columns
do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, ngram_join, perplexity, personal_data
from quire.llm.common import materialize, read_table, short_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near duplicates: five-word shingles, similarity of 0.8 or more
SHINGLE, SIMILARITY = 5, (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    short_batches(spark)
    judged = perplexity.score_quality(docs, [c for c in COLUMNS if c != "doc_id"])
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least id stays."""
    short_batches(spark)
    classes = ngram_join.jaccard_classes(docs, SHINGLE, *SIMILARITY)
    lost = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")), "lost")
    return docs.join(lost, F.col("doc_id") == F.col("_lost"), "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, the others stay as they are."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")).select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    clean = personal_data.redact(personal_data.find_personal_data(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark),
          ("PII", privacy), ("mixing sources", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split(" ")[0].lower())
    return docs


#: SQL cannot express the language model of the first stage
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
