"""G4 ``crawl_to_bundles``: the whole ingest as one Spark pipeline.

requests --J4--> seed urls --J5--> doc_type
pages --one pass over html--> facts (flag, hrefs, P13 text), a table in buckets of the url
facts --J8 (renders)--> rendered pages; the others --G1--> edges
seeds + edges --G2--> reached urls (min depth)
reached |><| facts --A8/W2--> bundle blocks [--SNK1--> files]

The html is read once and never shuffled; the crawl's result is joined to the
buckets of the facts.  Every page is converted, also those that no seed reaches.

All requests of a batch are crawled together (one BFS keyed by doc_type);
two requests that land on the same doc_type are crawled once.  A reached
URL with no row in the page table is a failed fetch: it is reported, and
the crawl continues around it.  Rendered (markdown) pages yield no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import bundles as B
from quire.operators.classify import with_dynamic_flag
from quire.functions import html as H
from quire.operators.common import sized
from quire.operators.crawl import DEFAULT_MAX_DEPTH, bfs
from quire.operators.links import resolve_links
from quire.operators.markdown import html_to_markdown
from quire.operators.render import good_renders
from quire.operators.resolve import infer_doc_type, resolve_keywords
from quire.session import scratch_path


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, url, is_dynamic, hrefs, text): all that later steps need of a
    page, from one pass over its html."""
    found = with_dynamic_flag(pages).select("page_id", "url", "is_dynamic", H.href_values(F.col("html")).alias("hrefs"), "html")
    return html_to_markdown(found, out_col="text")


def write_facts(pages: DataFrame) -> tuple[str, str]:
    """The facts as a table in buckets of the url: (name, path).  The html stays
    where it is; what is shuffled, once, are the facts."""
    spark = pages.sparkSession
    path = scratch_path(spark, "page-facts")
    name = "quire_page_facts_" + path.rsplit("-", 1)[-1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    page_facts(pages).repartition(n, "url").write.bucketBy(n, "url").sortBy("url").option("path", path).saveAsTable(name)
    return name, path


def crawl_to_bundles(pages: DataFrame, registry: DataFrame, requests: DataFrame, crawled_at: str,
                     max_depth: int = DEFAULT_MAX_DEPTH, scope: str = "page", renders: DataFrame | None = None,
                     out_path: str | None = None) -> dict[str, DataFrame]:
    """Returns ``{"resolved", "blocks", "failed", "summary"}``; writes the
    bundle files to ``out_path`` when given."""
    resolved = resolve_keywords(requests, registry)
    seeds = infer_doc_type(resolved.where(F.col("url").isNotNull())
                           .select(F.col("req_id").alias("seed_id"), F.col("url").alias("start_url")), registry)
    seed_rows = sized(seeds.select(F.col("doc_type").alias("seed"), F.col("start_url").alias("url")).distinct(), "seeds")
    spark = pages.sparkSession
    name, path = write_facts(pages)
    try:
        facts = spark.table(name)
        renders = spark.createDataFrame([], "url string, status int, success boolean, markdown string, error string") if renders is None else renders
        rendered = sized(good_renders(facts.select("page_id", "url", "is_dynamic"), renders), "rendered")
        # links come from pages kept as html (rendered pages are leaves)
        hrefs = facts.select("url", "hrefs").join(rendered.select("url"), "url", "left_anti").select(F.col("url").alias("src"), F.explode("hrefs").alias("href"))
        reached = bfs(resolve_links(hrefs, scope), seed_rows, max_depth).withColumnRenamed("seed", "doc_type")
        # a url may be in several page rows: its first one counts
        first = facts.groupBy("url").agg(F.min_by(F.struct("page_id", "text"), "page_id").alias("p"))
        found = sized(reached.join(first, "url", "left").select(*reached.columns, "p.page_id", "p.text"), "found")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    failed = found.where("page_id is null").select(*reached.columns)
    marked = rendered.select(F.col("page_id").alias("_page"), "markdown")
    texts = sized(found.where("page_id is not null").join(marked, F.col("page_id") == F.col("_page"), "left")
                  .select("doc_type", "depth", "url", "page_id", F.coalesce("markdown", "text").alias("text")), "texts")
    blocks = B.bundle_blocks(texts.select("doc_type", F.struct("depth", "url").alias("ord"), "url", "text"),
                             crawled_at)
    if out_path:
        B.write_bundles(blocks, out_path)
    per = texts.groupBy("doc_type").agg(F.count(F.lit(1)).alias("page_count"),
                                        F.count_if(F.col("text") == "").alias("empty_pages"),
                                        F.max("depth").alias("max_depth_reached"))
    fails = failed.groupBy("doc_type").agg(F.count(F.lit(1)).alias("failed_urls"))
    summary = (seed_rows.select(F.col("seed").alias("doc_type")).distinct()
               .join(per, "doc_type", "left").join(fails, "doc_type", "left")
               .select("doc_type",
                       F.coalesce("page_count", F.lit(0)).cast("bigint").alias("page_count"),
                       F.coalesce("failed_urls", F.lit(0)).cast("bigint").alias("failed_urls"),
                       F.coalesce("empty_pages", F.lit(0)).cast("bigint").alias("empty_pages"),
                       "max_depth_reached",
                       (F.coalesce("page_count", F.lit(0)) > 0).alias("success")))
    return {"resolved": resolved, "blocks": blocks, "failed": failed, "summary": summary}
