"""Document bundles: build (A8, W2, SNK1), read back (SRC10), count (A10).

A bundle is the text of every crawled page of one doc_type, in visit
order: front matter on the first block, then one block per page

    ---\\ndoc_type: X\\ncrawled_at: T\\nfirst_url: U\\n---\\n\\n     (first block only)
    # Page: <url>\\n\\n<text>\\n\\n<80 '='>\\n\\n

Blocks stay rows.  The first-page flag is a partial ``min(ord)`` per doc_type
joined back (no window over a hot doc_type), and the sink range-partitions
on (doc_type, ord) and sorts within partitions, so a doc_type holding a
third of all pages is written by several tasks as consecutive part files
(``part-00000`` < ``part-00001`` ...) instead of being concatenated in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import urls as U
from quire.operators.common import sized

# --- fixed values: bundle text layout --------------------------------------
SEPARATOR = "=" * 80
PAGE_HEADER = "# Page: "
FRONT_MATTER_FENCE = "---"
# --------------------------------------------------------------------------

BLOCK_END = "\n\n" + SEPARATOR + "\n\n"
FRONT_MATTER = r"^---\n([\s\S]*?)\n---\n\n"
#: blocks of a part file
FILE_BLOCKS = 10_000


def page_block(url: F.Column, text: F.Column) -> F.Column:
    return F.concat(F.lit(PAGE_HEADER), url, F.lit("\n\n"), text, F.lit(BLOCK_END))


def front_matter(doc_type: F.Column, crawled_at: F.Column, first_url: F.Column) -> F.Column:
    return F.concat(F.lit(FRONT_MATTER_FENCE + "\ndoc_type: "), doc_type, F.lit("\ncrawled_at: "), crawled_at,
                    F.lit("\nfirst_url: "), first_url, F.lit("\n" + FRONT_MATTER_FENCE + "\n\n"))


def bundle_blocks(pages: DataFrame, crawled_at: str) -> DataFrame:
    """pages(doc_type, ord, url, text) -> (doc_type, ord, url, is_first, block).

    ``ord`` is the visit order inside the doc_type (for a crawl: depth, then
    url); the smallest ord carries the front matter.
    """
    # one row per doc_type (partial aggregate) over the slim columns, written so
    # that its size is known: small ones are broadcast, so a doc_type holding a
    # third of the pages is no skewed join key
    first = sized(pages.groupBy("doc_type").agg(F.min(F.struct("ord", "url")).alias("f")), "first-pages")
    j = pages.join(first, "doc_type")
    is_first = F.col("ord") == F.col("f.ord")
    block = F.concat(
        F.when(is_first, front_matter(F.col("doc_type"), F.lit(crawled_at), F.col("url"))).otherwise(F.lit("")),
        page_block(F.col("url"), F.col("text")))
    return j.select("doc_type", "ord", "url", is_first.alias("is_first"), block.alias("block"))


def write_bundles(blocks: DataFrame, path: str, num_partitions: int | None = None, file_blocks: int = FILE_BLOCKS) -> None:
    """SNK1: ``<path>/doc_type=<X>/part-*.txt`` of at most ``file_blocks`` blocks,
    whose concatenation in file name order is the bundle.  Overwrites ``path``."""
    n = num_partitions or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (blocks.repartitionByRange(n, "doc_type", "ord").sortWithinPartitions("doc_type", "ord", "url")
     # the text sink adds one '\n' per row; drop the block's last one
     .select("doc_type", F.expr("substring(block, 1, length(block) - 1)").alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", file_blocks).partitionBy("doc_type").text(path))



def read_bundles(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """SRC10: bundle text files -> (doc_type, file, block_no, page_no, url, text,
    crawled_at, first_url).

    Works for files written by :func:`write_bundles` (``partitioned=True``:
    doc_type from the ``doc_type=`` folder, read as a string; its files are one
    bundle) and for plain ``<doc_type>.txt`` files (doc_type from front matter,
    else the file stem; each file is a bundle).  Files without front matter are
    accepted.

    The separator of the blocks is the line separator of the scan, so a large
    file is read by many tasks, a row a block.  ``block_no`` is the position in
    the file and ``page_no`` that in the bundle: a block's place within its split,
    plus the blocks of the splits before it, which are counted in a first pass
    that returns one row a split.
    """
    reader = spark.read.option("lineSep", BLOCK_END)
    reader = reader.schema("value string, doc_type string") if partitioned else reader
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    found = reader.text(path)
    partitioned = "doc_type" in found.columns  # the folders say so, asked or not
    raw = found.select("value", file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"),
                       (F.col("doc_type").cast("string") if partitioned else file).alias("bundle"))
    matter = F.when(F.col("value").startswith(FRONT_MATTER_FENCE + "\n"), F.regexp_extract("value", FRONT_MATTER, 1))
    splits = raw.groupBy("bundle", "file", "start").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"), F.min_by(matter, "at").alias("matter"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("bundle").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    field = lambda name: F.nullif(F.regexp_extract("matter", f"(?m)^{name}: (.*)$", 1), F.lit(""))
    splits = splits.select(F.col("file").alias("_file"), F.col("start").alias("_start"), "first_at",
                           F.coalesce(F.sum("n").over(before("bundle", "file")), F.lit(0)).alias("in_file"),
                           F.coalesce(F.sum("n").over(before("bundle")), F.lit(0)).alias("in_bundle"),
                           F.first("matter", ignorenulls=True).over(whole).alias("matter"))
    splits = sized(splits.select("_file", "_start", "first_at", "in_file", "in_bundle", field("doc_type").alias("own_type"), field("crawled_at").alias("crawled_at"),
                                 field("first_url").alias("first_url")), "splits")
    blocks = raw.join(splits, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    piece = F.when(F.col("value").startswith(FRONT_MATTER_FENCE + "\n"), F.regexp_replace("value", FRONT_MATTER, "")).otherwise(F.col("value"))
    place = F.col("at") - F.col("first_at")
    doc_type = F.col("bundle") if partitioned else F.coalesce("own_type", U.file_stem(F.col("file")))
    return blocks.where(piece != "").select(
        doc_type.alias("doc_type"), "file", (F.col("in_file") + place).cast("int").alias("block_no"), (F.col("in_bundle") + place).alias("page_no"),
        F.regexp_extract(piece, r"^# Page: (.*)", 1).alias("url"), F.regexp_replace(piece, r"^# Page: .*\n\n", "").alias("text"), "crawled_at", "first_url")


def pages_per_doc_type(blocks: DataFrame) -> DataFrame:
    """A10: page count per doc_type (and empty-text pages, a quality metric)."""
    return blocks.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("text") == "").alias("empty_pages"),
    )
