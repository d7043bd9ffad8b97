"""Mixing sources to target weights, with DataFrame functions only.

Sources (by code point, null last) have the weights 1, 2, 3, repeating, and
share all words of the table.  A source's target stops at ``max_epochs`` times
its words and the excess goes to the others by weight, until none is above:
with the level L that solves ``sum(min(max_epochs * words, L * weight)) =
total`` the targets are the terms of that sum.  L is read off prefix sums over
the sources in the order in which they reach their bound.

Documents of a source are ordered by a hash of the seed and the id.  The key
range of a source is cut into buckets of about ``bucket_rows`` documents; a
document's prefix sum is the sum of the buckets before its own plus a running
sum inside the bucket, so a hot source is spread over many tasks.  A source's
budget is its rounded target: whole epochs first, then documents in key order
up to the exact budget; the last one is taken in part (its first words).

Nulls: a null text has no words; null is a source of its own; a null id is
ordered as an empty string.  Repeated rows are documents of their own; those
with one id are ordered by size and digest of the text, so reruns agree.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: documents per key bucket
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, seed: str) -> Column:
    """60 uniform bits of the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, source_size, n_docs, weight, target): a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    fills = Window.orderBy("reach", "rank")
    src = (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
           .withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
           .withColumn("weight", w.cast("long"))
           .withColumn("bound", max_epochs * F.col("source_size"))
           .withColumn("reach", F.col("bound").cast("double") / F.col("weight"))
           .withColumn("full", F.coalesce(F.sum("bound").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("open", F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("total", F.sum("source_size").over(total))
           .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
           # the first source, in this order, that the level leaves below its bound
           .withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct(F.col("reach"), F.col("rank"), F.col("level"))))
                       .over(total)["level"]))
    return src.select("source", "rank", "source_size", "n_docs", "weight",
                      F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("digest"),
                                    hash_key(F.col("doc_id"), seed).alias("key")), "sized")
    src = materialize(source_targets(sized, weights, max_epochs), "sources")
    buckets = F.ceil(F.col("n_docs") / F.lit(bucket_rows))
    placed = (sized.join(src.withColumnRenamed("source", "src_name"), F.col("source").eqNullSafe(F.col("src_name")))
              .withColumn("bucket", F.floor(F.shiftright("key", 30).cast("double") * buckets / F.lit(float(1 << 30))).cast("long")))
    before = (placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
              .withColumn("bucket_before", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words"))
              .select("rank", "bucket", "bucket_before"))
    inside = (Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size", "digest")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (placed.join(before, ["rank", "bucket"])
            .withColumn("before", F.col("bucket_before") + F.sum("size").over(inside) - F.col("size"))
            .withColumn("budget", F.floor(F.col("target") + 0.5))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
                    .cast("long").alias("taken")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(text) AS digest,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS bound, (3 * source_size)::DOUBLE / (1 + rank % 3) AS reach FROM ranked),
filled AS (
  SELECT *, coalesce(sum(bound) OVER (ORDER BY reach, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
         sum(weight) OVER (ORDER BY reach, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS total
  FROM weighed),
levels AS (SELECT *, (total - full_words)::DOUBLE / open_weight::DOUBLE AS level FROM filled),
chosen AS (SELECT level FROM levels WHERE level <= reach ORDER BY reach, rank LIMIT 1),
targets AS (SELECT l.source, l.source_size, least(l.bound::DOUBLE, c.level * l.weight::DOUBLE) AS target FROM levels l, chosen c),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size, s.digest ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM placed
"""
