"""Bounded link-graph crawl (G2, G3) and run statistics (A3).

Level-synchronous breadth-first search over an edge table, keyed by
``(seed, url)`` so any number of seeds is walked in one pass:

    frontier(d) = distinct(frontier(d-1) |><| edges) anti-join visited

* One Spark job per level; the loop is bounded by ``max_depth`` and stops
  early on an empty frontier.
* Edges are de-duplicated once and written to the shared folder bucketed by
  ``(src, piece)``.  A hub, a page with more than ``HUB_DEGREE`` links, is cut
  into pieces by the hash of the link's target, so its links lie in many
  buckets; a hub in the frontier is repeated once a piece.  Each level shuffles
  the frontier to the edge buckets, never the edges.
* The visited set is a table bucketed by ``(seed, url)`` and partitioned by
  depth, to which each level appends its new rows.  The distinct candidates of
  a level are hashed to the same buckets, so the anti-join reads the visited
  rows where they lie: a level shuffles its candidates only, however much has
  been visited.  The frontier of the next level is one partition of the table.
* The tables also cut the lineage: a lost executor re-reads files of the shared
  ``spark.checkpoint.dir`` and never replays earlier levels.  Their catalog
  entries go when the crawl ends, failed or not; the files stay as the result.

Semantics: a page is visited at most once per seed, at its *minimum* depth
(the crawler walks depth-first with a global visited set, so its depths
depend on link order; the breadth-first result is the deterministic
superset).  Depth limit: visit while depth <= max_depth, expand links only
while depth < max_depth.  ``leaves`` lists pages that are visited but never
expanded (failed fetches, rendered pages -- those yield no links).  ``scopes``
gives a seed's scope: only links whose target starts with it are followed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.common import sized
from quire.session import scratch_path

DEFAULT_MAX_DEPTH = 3
#: links of a page that one piece holds on average
HUB_DEGREE = 100_000


def _bucketed(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh table name and its path in the shared folder."""
    path = scratch_path(spark, name)
    return f"quire_{name}_" + path.rsplit("-", 1)[-1], path


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class LinkTable:
    """Distinct links in buckets of (src, piece), and the pieces of each hub."""

    name: str
    hubs: DataFrame

    @classmethod
    def write(cls, edges: DataFrame, hub_degree: int = HUB_DEGREE) -> LinkTable:
        spark = edges.sparkSession
        links = sized(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "links")
        hubs = sized(links.groupBy(F.col("src").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / F.lit(hub_degree)).cast("int").alias("pieces"))
                     .where("pieces > 1"), "hubs")
        name, path = _bucketed(spark, "edges")
        piece = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("pieces")), F.lit(0)).cast("int")
        (links.join(hubs, F.col("src") == F.col("hub"), "left").select("src", piece.alias("piece"), "dst")
         .write.bucketBy(_buckets(spark), "src", "piece").option("path", path).saveAsTable(name))
        return cls(name, hubs)

    def targets(self, frontier: DataFrame) -> DataFrame:
        """The frontier's columns but ``url``, and the ``url`` each of its links leads to."""
        spark = frontier.sparkSession
        last = F.coalesce(F.col("pieces"), F.lit(1)) - 1
        ends = (frontier.join(self.hubs, F.col("url") == F.col("hub"), "left")
                .select(*frontier.columns, F.explode(F.sequence(F.lit(0), last)).alias("piece")))
        links = spark.table(self.name)
        return (ends.join(links, (ends["url"] == links["src"]) & (ends["piece"] == links["piece"]))
                .select(*[ends[c] for c in frontier.columns if c != "url"], links["dst"].alias("url")))


@dataclass
class Visited:
    """(seed, url, depth) in buckets of (seed, url), a partition for each depth."""

    spark: SparkSession
    name: str
    path: str

    @classmethod
    def start(cls, seeds: DataFrame) -> Visited:
        out = cls(seeds.sparkSession, *_bucketed(seeds.sparkSession, "visited"))
        out.add(seeds.select("seed", "url").distinct(), 0)
        return out

    def add(self, level: DataFrame, depth: int) -> None:
        (level.select("seed", "url", F.lit(depth).alias("depth")).write.partitionBy("depth").bucketBy(_buckets(self.spark), "seed", "url")
         .option("path", self.path).mode("append").saveAsTable(self.name))

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The distinct candidates that no level has visited."""
        return candidates.select("seed", "url").distinct().join(self.spark.table(self.name).select("seed", "url"), ["seed", "url"], "left_anti")

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("depth") == depth).select("seed", "url")

    def rows(self) -> DataFrame:
        """All levels, read from the files; needs no catalog entry."""
        return self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.path).select("seed", "url", "depth")


def next_level(visited: Visited, links: LinkTable, frontier: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """The pages that the frontier's links lead to and that are not visited yet."""
    if scopes is None:
        return visited.unseen(links.targets(frontier))
    reached = links.targets(frontier.join(scopes.select("seed", "scope"), "seed", "left"))
    return visited.unseen(reached.where(F.col("scope").isNull() | F.col("url").startswith(F.col("scope"))))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH, leaves: DataFrame | None = None,
        scopes: DataFrame | None = None, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Reachable ``(seed, url, depth)`` with minimum depth per (seed, url).

    ``seeds``: columns ``seed, url`` (the seed key and its start node; a seed
    may have several).  ``edges``: columns ``src, dst`` with the same type as
    ``url``; a link without a source or target leads nowhere.  ``leaves``: a
    column ``url``.  ``scopes``: columns ``seed, scope``, at most one row a seed;
    a seed without one, or with a null, goes anywhere.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be >= 0")
    spark = seeds.sparkSession
    visited = Visited.start(seeds)
    names = [visited.name]
    try:
        if max_depth:
            links = LinkTable.write(edges, hub_degree)
            names.append(links.name)
            ends = None if leaves is None else sized(leaves.select("url").distinct(), "leaves")
            known = None if scopes is None else sized(scopes.select("seed", "scope"), "scopes")
        for depth in range(1, max_depth + 1):
            frontier = visited.level(depth - 1)
            frontier = frontier if ends is None else frontier.join(ends, "url", "left_anti").select("seed", "url")
            visited.add(next_level(visited, links, frontier, known), depth)
            if depth < max_depth and visited.level(depth).isEmpty():
                break
        return visited.rows()
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def crawl_registry(edges: DataFrame, registry: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH,
                   leaves: DataFrame | None = None) -> DataFrame:
    """Crawl every registry entry (``keyword, url``) in one pass.

    doc_type = keyword (passed explicitly, as the batch job does, so the
    first-match reverse lookup never merges two entries).
    """
    seeds = registry.select(F.col("keyword").alias("seed"), "url")
    return bfs(edges, seeds, max_depth, leaves).withColumnRenamed("seed", "doc_type")


def crawl_runs(registry: DataFrame, reached: DataFrame, failed_pages: DataFrame | None = None) -> DataFrame:
    """Per registry entry: page_count (pages reached), failed page count,
    success = at least one page reached (an entry with zero pages is a
    failure here; the original job counted files, not pages)."""
    per = reached.groupBy("doc_type").agg(F.count(F.lit(1)).alias("page_count"),
                                          F.max("depth").alias("max_depth_reached"))
    if failed_pages is not None:
        fails = failed_pages.groupBy("doc_type").agg(F.count(F.lit(1)).alias("failed_pages"))
        per = per.join(fails, "doc_type", "left")
    else:
        per = per.withColumn("failed_pages", F.lit(None).cast("bigint"))
    out = registry.select(F.col("keyword").alias("doc_type")).join(per, "doc_type", "left")
    return out.select(
        "doc_type",
        F.coalesce("page_count", F.lit(0)).cast("bigint").alias("page_count"),
        F.coalesce("failed_pages", F.lit(0)).cast("bigint").alias("failed_pages"),
        "max_depth_reached",
        (F.coalesce("page_count", F.lit(0)) > 0).alias("success"),
        F.when(F.coalesce("page_count", F.lit(0)) == 0,
               F.concat(F.lit("No pages crawled for "), F.col("doc_type"))).alias("error"),
    )


def crawl_run_errors(runs: DataFrame) -> DataFrame:
    """A3: the errors of a run as rows (doc_type, error), one a failed entry."""
    return runs.where(~F.col("success")).select("doc_type", "error")


def crawl_run_stats(runs: DataFrame) -> DataFrame:
    """A3: one-row totals over all registry entries.  ``file_count`` is one
    bundle per successful entry; ``total_pages`` counts real pages."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_apis"),
        F.count_if("success").alias("successful_apis"),
        F.count_if(~F.col("success")).alias("failed_apis"),
        F.count_if("success").alias("file_count"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("bigint").alias("total_pages"),
    )
