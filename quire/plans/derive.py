"""Inputs of the corpus jobs derived from the driver tables.

The driver tables are generic (pages, documents, orders, lineitem, ...);
each function below maps one of them onto the shape a corpus job consumes.
Every row of the source table is used -- nothing is sampled or capped -- so
the work of each registered query grows with the table.  The DuckDB oracle
(:mod:`quire.plans.oracle`) derives the same inputs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import dates as D
from quire.functions import html as H
from quire.functions import urls as U
from quire.sources import tables as T

# --- fixed values of the derivations ---------------------------------------
NOW = "2001/09/01 00:00:00"            # retention clock (orders end 2001-08)
CRAWLED_AT = "2024/02/01 09:00:00"     # bundle front matter
MAX_AGE_DAYS = 90
LOAD_TIMES = ["2024/02/01 09:00:00", "2024/02/02 10:30:00", "2024/02/03 08:15:00"]  # of three loads
FRAMEWORK_MARKERS = [                  # by page_id % 7; 5 and 6 get none
    '<div class="shell" id="root">',
    '<section v-cloak>',
    '<body ng-app>',
    '<link rel="preload" href="/_next/static/main.css">',
    '<p>__NUXT__</p>',
]
FILE_EXTENSIONS = [".txt", ".md", ".pdf", ".exe", ".TXT", ".png", ".zip", ".jpeg", ".md", ""]  # by doc_id % 10
BYTES_PER_CHAR = 3000                  # file size = n_chars * this (some exceed 50 MiB)
FETCH_STATUSES = [200, 200, 200, 404, 403, 429, 500, 503, 302, 200, 200]  # by event_id % 11
RENDER_FAIL_STATUSES = [429, 401, 500, 200]                               # by page_id % 4
PRIORITY_DOC_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NO STORE"]
# --------------------------------------------------------------------------


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a framework marker in front and a padding script at the
    end (0-4x the page length), so that some pages classify as dynamic."""
    p = T.pages(spark, sf_dir)
    marker = F.coalesce(F.try_element_at(F.array(*[F.lit(m) for m in FRAMEWORK_MARKERS]),
                                     (F.col("page_id") % 7 + 1).cast("int")), F.lit(""))
    pad = F.expr("repeat('x', CAST(length(html) * (page_id % 5) AS INT))")
    return p.select("page_id", "url",
                    F.concat(marker, F.col("html"), F.lit("<script>"), pad, F.lit("</script>")).alias("html"))


#: a page that comes again has its own id plus this
AGAIN = 1_000_000_000_000


def arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Pages as they arrive at two runs of the re-crawl: those with an even id,
    then the others and, once more, every third page of the table."""
    p = T.pages(spark, sf_dir)
    again = p.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + AGAIN)
    return [p.where("page_id % 2 = 0"), p.where("page_id % 2 <> 0").unionByName(again)]


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with four more links: below the page, beside it, to its host's
    root and to another host."""
    p = T.pages(spark, sf_dir)
    path = U.scope_path("url")
    links = F.concat(F.lit('<a href="'), path, F.lit("/part?p=1#x\"></a><a href='"), F.lit("beside.html'></a><a class=\"a\" href=/></a><a href=\"https://other.example/"),
                     path, F.lit('/part">o</a>'))
    return p.select("page_id", "url", F.concat(links, F.col("html")).alias("html"))


def host_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL registry from page hosts: keyword = host, url = https://host/,
    pos = first page id of the host."""
    p = T.pages(spark, sf_dir, with_html=False)
    return (p.groupBy(U.url_netloc("url").alias("keyword")).agg(F.min("page_id").alias("pos"))
            .select("pos", "keyword", F.col("keyword").alias("name"),
                    F.concat(F.lit("https://"), F.col("keyword"), F.lit("/")).alias("url"),
                    F.lit(None).cast("string").alias("description")))


def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests per page: its url, the host upper-cased, the first host
    label, the host itself, and a miss (empty for every tenth page)."""
    p = T.pages(spark, sf_dir, with_html=False).select("page_id", "url", U.url_netloc("url").alias("host"))
    kinds = F.array(
        F.col("url"), F.upper("host"), F.split("host", r"\.").getItem(0), F.col("host"),
        F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("nohost-"), F.col("page_id"))))
    return p.select("page_id", F.posexplode(kinds).alias("k", "keyword_or_url")).select(
        (F.col("page_id") * 5 + F.col("k")).alias("req_id"), "keyword_or_url")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store registry from orders: doc_type = priority, pos = order key,
    created_at = order date as registry text; every 20th entry has no date,
    an ISO date or garbage."""
    o = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                "o_orderstatus")
    k = F.col("o_orderkey") % 20
    created = (F.when(k == 0, F.lit(None).cast("string"))
               .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(k == 2, F.lit("7th of May"))
               .otherwise(F.date_format("o_orderdate", D.REGISTRY_TIME_FORMAT)))
    return o.select(F.col("o_orderpriority").alias("doc_type"), F.col("o_orderkey").alias("pos"),
                    F.concat(F.lit("stores/"), F.col("o_orderkey")).alias("rag_id"), created.alias("created_at"),
                    F.concat(F.lit("customer "), F.col("o_custkey")).alias("description"),
                    "o_orderstatus")


def delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mocked delete results: orders with key % 7 = 3 fail."""
    o = T.table(spark, sf_dir, "orders", "o_orderkey")
    bad = F.col("o_orderkey") % 7 == 3
    return o.select(F.concat(F.lit("stores/"), F.col("o_orderkey")).alias("rag_id"), (~bad).alias("ok"),
                    F.when(bad, F.lit("Permission denied")).alias("error"))


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, batch = source, pos = doc_id."""
    d = T.table(spark, sf_dir, "documents", "doc_id", "source")
    ext = F.coalesce(F.try_element_at(F.array(*[F.lit(e) for e in FILE_EXTENSIONS]),
                                  (F.col("doc_id") % 10 + 1).cast("int")), F.lit(""))
    return d.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("pos"),
                    F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/doc"), F.col("doc_id"), ext)
                    .alias("file_path"))


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each document, below ``doc_type=<source>``;
    every ninth document ends in bytes that are no UTF-8."""
    from quire.session import scratch_path
    from quire.sources.files import write_text_files

    path = scratch_path(spark, "corpus")
    broken = F.when(F.col("doc_id") % 9 == 0, F.expr("cast(unhex('C328') as string)")).otherwise(F.lit(""))
    write_text_files(T.table(spark, sf_dir, "documents", "doc_id", "source", "text", balanced=True)
                     .select(F.coalesce("source", F.lit("none")).alias("doc_type"), F.concat(F.coalesce("text", F.lit("")), broken).alias("value")), path)
    return path


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files present on disk: every document except the ones labelled toxic
    (deleted), size = n_chars * BYTES_PER_CHAR; utf8_ok = no U+FFFD."""
    d = T.table(spark, sf_dir, "documents", "doc_id", "source", "n_chars", "text")
    toxic = T.table(spark, sf_dir, "labels", "doc_id", "toxic").where(F.col("toxic") == 1).select("doc_id")
    req = file_requests(spark, sf_dir).select(F.col("pos").alias("doc_id"), "file_path")
    return (d.join(toxic, "doc_id", "left_anti").join(req, "doc_id")
            .select(F.col("file_path").alias("path"), (F.col("n_chars") * BYTES_PER_CHAR).alias("length"),
                    (F.instr("text", "�") == 0).alias("utf8_ok")))


def load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mocked per-file load failures: documents labelled quality = 0."""
    low = T.table(spark, sf_dir, "labels", "doc_id", "quality").where(F.col("quality") == 0)
    req = file_requests(spark, sf_dir)
    return req.join(low.select(F.col("doc_id").alias("pos")), "pos").select(
        "batch_id", "file_path", F.lit("no room left in the store").alias("error")).distinct()


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP outcomes from events: status by event_id % 11; 'error' events are
    timeouts (value >= 100) or network errors; registry entry = user."""
    e = T.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    status = F.element_at(F.array(*[F.lit(s) for s in FETCH_STATUSES]), (F.col("event_id") % 11 + 1).cast("int"))
    kind = (F.when((F.col("event_type") == "error") & (F.col("value") >= 100), F.lit("timeout"))
            .when(F.col("event_type") == "error", F.lit("network")))
    return e.select("event_id", "user_id",
                    F.concat(F.lit("https://site"), F.col("user_id"), F.lit(".example.com/e/"), F.col("event_id"))
                    .alias("url"), status.alias("status"), kind.alias("error_kind"))


def render_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A render response for each page, by page_id % 5: whole, without url,
    without markdown and time, no success, or an error without a message."""
    k = F.col("page_id") % 5
    full = F.when(k != 2, F.concat(F.lit("rendered "), F.col("page_id")))
    return T.pages(spark, sf_dir, with_html=False).select(
        F.col("url").alias("request_url"), F.when(k == 4, F.lit(503)).otherwise(F.lit(200)).alias("status"), (k != 3).alias("success"),
        full.alias("markdown"), F.when(k != 1, F.concat(F.col("url"), F.lit("#done"))).alias("url"),
        F.when(k != 2, F.lit(CRAWLED_AT)).alias("timestamp"), F.when(k == 3, F.lit("no browser")).alias("error"))


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One render result per page, kind by page_id % 3: 0 ok (markdown),
    1 failed with a message, 2 gateway timeout without a message."""
    p = T.pages(spark, sf_dir, with_html=False)
    m = F.col("page_id") % 3
    fail_status = F.element_at(F.array(*[F.lit(s) for s in RENDER_FAIL_STATUSES]),
                               (F.col("page_id") % 4 + 1).cast("int"))
    return p.select(
        "url",
        F.when(m == 0, F.lit(200)).when(m == 1, fail_status).otherwise(F.lit(504)).alias("status"),
        (m == 0).alias("success"),
        F.when(m == 0, F.concat(F.lit("# rendered "), F.col("url"))).alias("markdown"),
        F.when(m == 1, F.lit("Navigation timeout")).alias("error"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link graph over parts: each order line is represented by its smallest
    part key; consecutive lines of an order are linked (src -> dst).  The
    per-line aggregate makes the join 1:1, so no group of duplicate lines
    is ever paired up."""
    li = T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    a = lines.select("l_orderkey", "l_linenumber", F.col("part").alias("src"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def part_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single crawl seed: the part of the first line of the first order."""
    li = T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    first = li.agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("m"))
    return first.select(F.lit("seed").alias("seed"), F.col("m.l_partkey").alias("url"))


def brand_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl registry: one entry per part brand, seeded at its smallest part."""
    p = T.table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return p.groupBy(F.col("p_brand").alias("keyword")).agg(F.min("p_partkey").alias("url"))


def section_url(part: Column) -> Column:
    """A part as a page of one of four sections."""
    return F.concat(F.lit("s"), part % 4, F.lit("/"), part)


def section_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, url, scope) of every brand: its smallest part, and that part's section."""
    start = brand_registry(spark, sf_dir)
    return start.select(F.col("keyword").alias("seed"), section_url(F.col("url")).alias("url"), F.concat(F.lit("s"), F.col("url") % 4, F.lit("/")).alias("scope"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages for bundles: doc_type = host slug, ord = page id,
    text = visible text."""
    p = T.pages(spark, sf_dir)
    return p.select(U.host_slug("url").alias("doc_type"), F.col("page_id").alias("ord"), "url",
                    H.visible_text("html").alias("text"))


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the stores: the doc_type by doc_id % 5; every third document
    is in an older store, which no prompt may search."""
    from quire.operators.stores import latest_store

    dt = F.element_at(F.array(*[F.lit(x) for x in PRIORITY_DOC_TYPES[:5]]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = T.table(spark, sf_dir, "documents", "doc_id").withColumn("doc_type", dt)
    return d.join(latest_store(stores(spark, sf_dir)), "doc_type").select(
        F.when(F.col("doc_id") % 3 == 0, F.lit("stores/old")).otherwise(F.col("rag_id")).alias("store_id"), "doc_id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as prompts; doc_type by conv_id % 6 (the
    sixth has no store)."""
    c = T.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    dt = F.element_at(F.array(*[F.lit(x) for x in PRIORITY_DOC_TYPES]), (F.col("conv_id") % 6 + 1).cast("int"))
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"),
        dt.alias("doc_type"))


def page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl registry for the full ingest: one entry per host, seeded at the
    host's first page."""
    p = T.pages(spark, sf_dir, with_html=False)
    return (p.groupBy(U.url_netloc("url").alias("keyword"))
            .agg(F.min("page_id").alias("pos"), F.min_by("url", "page_id").alias("url"))
            .select("pos", "keyword", F.col("keyword").alias("name"), "url",
                    F.lit(None).cast("string").alias("description")))


def host_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl request per host, by keyword."""
    return page_registry(spark, sf_dir).select(F.col("pos").alias("req_id"), F.col("keyword").alias("keyword_or_url"))
