"""Registered queries: one per operator family of the blueprint.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (through :mod:`quire.plans.derive`).  Column names match the
DuckDB oracle in :mod:`quire.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import urls as U
from quire.operators import bundles as B
from quire.operators import classify as C
from quire.operators import crawl as G
from quire.operators import files as V
from quire.operators import links as L
from quire.operators import markdown as M
from quire.operators import render as R
from quire.operators import resolve as J
from quire.operators import retrieve as Q
from quire.operators import stores as S
from quire.plans import derive as D
from quire.sources import files as FS
from quire.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_features(D.marked_pages(spark, sf_dir))


def site_render_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.site_render_needs(C.page_features(D.marked_pages(spark, sf_dir)))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir, with_html=False)
    u = F.col("url")
    return p.select(
        "page_id", U.is_url(u).alias("is_url"), U.url_scheme(u).alias("scheme"), U.url_netloc(u).alias("netloc"),
        U.url_path(u).alias("path"), U.url_query(u).alias("query"), U.defrag(u).alias("defragged"),
        U.scope_path(u).alias("scope"), U.host_slug(u).alias("host_slug"), U.file_name(U.url_path(u)).alias("name"),
        U.file_stem(U.url_path(u)).alias("stem"), U.file_ext(U.url_path(u)).alias("ext"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_links(T.pages(spark, sf_dir), scope="site")


def page_links_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawler scope (page path prefix), over pages with links of every kind."""
    return L.extract_links(D.linked_pages(spark, sf_dir), scope="page")


def resolve_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolve_keywords(D.resolve_requests(spark, sf_dir), D.host_registry(spark, sf_dir))


def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 as rows: the registry keywords that contain each request."""
    return J.keyword_matches(D.resolve_requests(spark, sf_dir), D.host_registry(spark, sf_dir))


def infer_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = T.pages(spark, sf_dir, with_html=False).select(F.col("page_id").alias("seed_id"),
                                                           F.col("url").alias("start_url"))
    return J.infer_doc_type(seeds, D.host_registry(spark, sf_dir))


def latest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_store(D.stores(spark, sf_dir))


def stores_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the entries of one doc_type."""
    return S.stores_of_type(D.stores(spark, sf_dir), D.PRIORITY_DOC_TYPES[0]).select("doc_type", "pos", "rag_id", "created_at", "description")


def ordered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 as rows, after SNK3 and its read-back."""
    from quire.session import scratch_path
    from quire.sources import registry as REG

    out = scratch_path(spark, "registry")
    REG.export_store_registry(D.stores(spark, sf_dir), out)
    return S.ordered_entries(REG.scan_store_registry_lines(spark, out))


def registered_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, SNK2, W1: the stores of all loaded batches are registered in two
    batches at one time; the first of a doc_type stays the latest."""
    from quire.session import scratch_path

    path = scratch_path(spark, "stores")
    loaded = load_outcome(spark, sf_dir).where("success").select(
        F.substring("batch_id", 1, 4).alias("doc_type"), F.col("store_id").alias("rag_id"), F.col("batch_id").alias("description"))
    even = F.length("description") % 2 == 0
    for batch in (loaded.where(even), loaded.where(~even)):
        S.register_stores(path, batch.withColumn("pos", F.col("description")), D.CRAWLED_AT)
    return S.latest_store(spark.read.parquet(path))


def file_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 per file: uploaded, invalid or failed."""
    return V.file_outcomes(file_validation(spark, sf_dir), D.load_errors(spark, sf_dir))


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.store_documents(file_outcomes(spark, sf_dir))


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: files and bytes by extension."""
    listing = D.file_listing(spark, sf_dir).select(U.file_ext("path").alias("extension"), F.col("length").alias("size"))
    return V.file_counts(listing, by="extension")


def registry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as registry time strings, by month."""
    from quire.functions import dates as DT

    o = T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select("o_orderkey", DT.registry_time_of(F.col("o_orderdate").cast("timestamp_ntz") + hours).alias("registry_time"))


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.store_counts(D.stores(spark, sf_dir))


def expired_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expired_stores(D.stores(spark, sf_dir), D.NOW, D.MAX_AGE_DAYS)


def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = S.apply_retention(D.stores(spark, sf_dir), D.NOW, D.delete_outcomes(spark, sf_dir), D.MAX_AGE_DAYS)
    return report


def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = S.apply_retention(D.stores(spark, sf_dir), D.NOW, D.delete_outcomes(spark, sf_dir), D.MAX_AGE_DAYS)
    return S.retention_summary(report)


def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 with the grand total."""
    return S.retention_totals(retention_report(spark, sf_dir))


def registry_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, remaining = S.apply_retention(D.stores(spark, sf_dir), D.NOW, D.delete_outcomes(spark, sf_dir),
                                     D.MAX_AGE_DAYS)
    return remaining.select("doc_type", "pos", "rag_id", "created_at")


def unregister_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = D.stores(spark, sf_dir)
    removals = st.where(F.col("o_orderstatus") == "F").select("doc_type", "rag_id")
    return S.unregister_stores(st, removals).select("doc_type", "pos", "rag_id", "created_at")


def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = D.file_listing(spark, sf_dir)
    return V.validate(D.file_requests(spark, sf_dir), listing.select("path", "length"),
                      listing.select("path", "utf8_ok"))


def load_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load_outcome(file_validation(spark, sf_dir), D.load_errors(spark, sf_dir))


def load_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = D.file_requests(spark, sf_dir).withColumn("doc_type", F.col("batch_id"))
    return V.load_store(req, D.file_listing(spark, sf_dir).select("path"))


def committed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, SNK6, SNK7 as committed loads, the last one tried twice; then the
    newest store of each doc_type and its documents."""
    from quire.operators import loads as C
    from quire.operators.common import sized
    from quire.session import scratch_path

    base = scratch_path(spark, "store-loads")
    requests = D.file_requests(spark, sf_dir).withColumns({"doc_type": F.col("batch_id"), "batch_id": F.concat(F.lit("whole|"), "batch_id")})
    whole = sized(V.load_store(requests, D.file_listing(spark, sf_dir).select("path")).where("success"), "whole")
    members = requests.join(whole.select("batch_id", "store_id"), "batch_id").select("store_id", "batch_id", "pos", "file_path")
    C.commit_load(base, "whole", whole, members, D.LOAD_TIMES[0])
    validated = sized(file_validation(spark, sf_dir), "validated")
    single = sized(V.load_file(validated).where("success"), "single")
    C.commit_load(base, "single", single, single.withColumn("pos", F.lit(0)), D.LOAD_TIMES[1])
    errors = D.load_errors(spark, sf_dir)
    partial = V.load_outcome(validated, errors).where("success")
    for _ in range(2):
        C.commit_load(base, "partial", partial, V.store_documents(V.file_outcomes(validated, errors)), D.LOAD_TIMES[2])
    newest = S.latest_store(C.read_registry(spark, base))
    return (newest.join(C.read_documents(spark, base), F.col("rag_id") == F.col("store_id"))
            .select("doc_type", "rag_id", "created_at", "load", "file_path"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, SRC9, P22 over files: a file per document in its source's folder,
    listed without content, then read for its bytes."""
    path = D.document_files(spark, sf_dir)
    listing = FS.scan_corpus_files(spark, path)
    bodies = FS.read_bodies(spark, path, V.MAX_FILE_BYTES, "*.txt", recursive=True)
    probe = V.utf8_check(bodies, F.sha2("content", 256).alias("sha256"))
    return listing.join(probe, "path").select(F.regexp_replace("doc_type", "^doc_type=", "").alias("doc_type"), "size", "utf8_ok", "sha256")


def upload_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC8, U1 over the same files: the inputs of a load of every source,
    and of one more that has no files."""
    path = D.document_files(spark, sf_dir)
    names = T.table(spark, sf_dir, "documents", "source").select(F.concat(F.lit("doc_type="), F.coalesce("source", F.lit("none"))).alias("doc_type"))
    inputs = FS.gather_upload_inputs(spark, path, names.unionByName(spark.createDataFrame([("doc_type=missing",)], "doc_type string")))
    return inputs.groupBy(F.regexp_replace("doc_type", "^doc_type=", "").alias("doc_type")).agg(
        F.count("file_path").alias("n_files"), F.count_distinct("pos").alias("n_pos"),
        F.max(F.regexp_replace("error", "doc_type=", "")).alias("error"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = file_validation(spark, sf_dir).where("valid")
    le = D.load_errors(spark, sf_dir).select("file_path", F.lit(True).alias("_failed"))
    docs = v.join(le, "file_path", "left").select(
        V.store_id_of(F.col("batch_id")).alias("store_id"),
        F.when(F.col("_failed").isNull(), F.lit("active")).otherwise(F.lit("failed")).alias("state"), "size")
    return Q.store_stats(docs)


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.fetches(spark, sf_dir)
    o = R.fetch_outcome(F.col("status"), F.col("url"), F.col("error_kind"))
    return f.select("event_id", "user_id", "status", o["ok"].alias("ok"), o["error"].alias("error"))


def fetch_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 over fetch outcomes: one registry entry per user."""
    o = fetch_outcomes(spark, sf_dir)
    runs = o.groupBy(F.col("user_id").alias("doc_type")).agg(
        F.count_if("ok").alias("page_count"), F.count_if(~F.col("ok")).alias("failed_pages"))
    runs = runs.select("doc_type", "page_count", "failed_pages", (F.col("page_count") > 0).alias("success"))
    return G.crawl_run_stats(runs)


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.bfs(D.part_graph(spark, sf_dir), D.part_seed(spark, sf_dir), max_depth=3)
    return out.select("seed", F.col("url").alias("node"), "depth")


def crawl_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.crawl_registry(D.part_graph(spark, sf_dir), D.brand_registry(spark, sf_dir), max_depth=3)
    return out.select("doc_type", F.col("url").alias("node"), "depth")


def crawl_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 with the seed's scope: every brand walks within the section of its start."""
    edges = D.part_graph(spark, sf_dir).select(D.section_url(F.col("src")).alias("src"), D.section_url(F.col("dst")).alias("dst"))
    starts = D.section_scopes(spark, sf_dir)
    return G.bfs(edges, starts.select("seed", "url"), max_depth=4, scopes=starts.select("seed", "scope")).select(
        F.col("seed").alias("doc_type"), "url", "depth")


def crawl_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = D.brand_registry(spark, sf_dir)
    reached = G.crawl_registry(D.part_graph(spark, sf_dir), reg, max_depth=3)
    runs = G.crawl_runs(reg, reached)
    return runs.select("doc_type", "page_count", "max_depth_reached", "success")


def crawl_run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: of a run over the brands and one more entry a brand whose page is gone, the errors."""
    brands = D.brand_registry(spark, sf_dir)
    gone = brands.select(F.concat(F.lit("gone "), F.col("keyword")).alias("keyword"), (-F.col("url") - 1).alias("url"))
    registry = brands.unionByName(gone)
    pages = T.table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "url")
    reached = G.crawl_registry(D.part_graph(spark, sf_dir), registry, max_depth=1).join(pages, "url", "left_semi")
    return G.crawl_run_errors(G.crawl_runs(registry, reached))


def scan_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: render responses with their defaults."""
    return R.scan_renders(D.render_responses(spark, sf_dir))


def render_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.with_dynamic_flag(D.marked_pages(spark, sf_dir))
    out = R.render_fallback(pages, D.renders(spark, sf_dir))
    return out.select("page_id", "url", "is_dynamic", "render_state", "content_kind",
                      F.length("content").cast("bigint").alias("content_len"), "render_error")


def bundle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bundle_blocks(D.doc_pages(spark, sf_dir), D.CRAWLED_AT)


def crawl_to_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve -> doc_type -> crawl (site scope, depth 3) -> render
    fallback -> markdown -> bundles, written and read back; per-doc_type summary."""
    from quire.plans.ingest import crawl_to_bundles as run
    from quire.session import scratch_path

    out = run(T.pages(spark, sf_dir), D.page_registry(spark, sf_dir), D.host_requests(spark, sf_dir),
              D.CRAWLED_AT, max_depth=3, scope="site", renders=D.renders(spark, sf_dir),
              out_path=(path := scratch_path(spark, "bundles")))
    written = B.pages_per_doc_type(B.read_bundles(spark, path, partitioned=True)).select("doc_type", F.col("page_count").alias("bundle_pages"))
    return out["summary"].join(written, "doc_type", "left").withColumn("bundle_pages", F.coalesce("bundle_pages", F.lit(0)).cast("bigint"))


def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 then SRC10: write the bundles to the shared folder, read them back in
    their order and with their front matter."""
    from quire.session import scratch_path

    out = scratch_path(spark, "bundles")
    B.write_bundles(B.bundle_blocks(D.doc_pages(spark, sf_dir), D.CRAWLED_AT), out, file_blocks=3)
    return B.read_bundles(spark, out, partitioned=True).select("doc_type", "page_no", "url", "text", "crawled_at", "first_url")


def pages_per_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pages_per_doc_type(D.doc_pages(spark, sf_dir))


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.html_to_markdown(T.pages(spark, sf_dir)).select("page_id", "url", "markdown")


def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, gated: the letters and digits of the markdown, and its link targets."""
    md = M.html_to_markdown(T.pages(spark, sf_dir))
    link = r"\]\(([^)]*)\)"
    letters = F.regexp_replace(F.regexp_replace("markdown", link, ""), r"[^\p{L}\p{N}]", "")
    return md.select("page_id", F.md5(letters).alias("letters"), F.length(letters).cast("bigint").alias("n_letters"),
                     F.array_join(F.regexp_extract_all("markdown", F.lit(link), 1), " ").alias("links"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.chunk_documents(T.table(spark, sf_dir, "documents", "doc_id", "text", balanced=True))


def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = Q.chunk_documents(T.table(spark, sf_dir, "documents", "doc_id", "text", balanced=True))
    prompts = T.table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("item_id", "prompt_id")
    return Q.bm25_topk(prompts, chunks, k=5)


def retrieve_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label", balanced=True)
    return Q.vector_topk(e, Q.centroid_queries(e), k=5)


def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.assemble_context(D.prompts(spark, sf_dir), D.stores(spark, sf_dir))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt -> latest store of its doc_type -> the best passages of that store."""
    documents = T.table(spark, sf_dir, "documents", "doc_id", "text", balanced=True)
    return Q.answer_prompts(D.prompts(spark, sf_dir), D.stores(spark, sf_dir), D.store_documents(spark, sf_dir), documents, k=3)


def stream_page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.streaming.ingest import page_features_stream_run
    return page_features_stream_run(spark, sf_dir)


def stream_recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the re-crawl stream: features and link counts of each url's first page."""
    import os

    from quire.session import scratch_path
    from quire.streaming import recrawl as RC

    base = scratch_path(spark, "recrawl")
    source, out = os.path.join(base, "arrived"), os.path.join(base, "out")
    for run, pages in enumerate(D.arrivals(spark, sf_dir)):
        pages.write.parquet(os.path.join(source, f"run-{run}"))
        RC.run_recrawl(spark, source, out, D.CRAWLED_AT)
    features, links = RC.read_sinks(spark, out)
    n_links = links.groupBy(F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("n_links"))
    return features.join(n_links, "url", "left").select("page_id", "url", "host", "text_len", "frameworks", "is_dynamic",
                                                        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


QUERIES: dict[str, Query] = {
    "site_render_needs": site_render_needs,
    "page_features": page_features,
    "url_parts": url_parts,
    "page_links": page_links,
    "page_links_scoped": page_links_scoped,
    "resolve_keywords": resolve_keywords,
    "keyword_matches": keyword_matches,
    "infer_doc_type": infer_doc_type,
    "latest_store": latest_store,
    "store_counts": store_counts,
    "stores_of_type": stores_of_type,
    "ordered_entries": ordered_entries,
    "registered_latest": registered_latest,
    "file_outcomes": file_outcomes,
    "store_documents": store_documents,
    "file_counts": file_counts,
    "registry_times": registry_times,
    "expired_stores": expired_stores,
    "retention_report": retention_report,
    "retention_summary": retention_summary,
    "retention_totals": retention_totals,
    "registry_after_retention": registry_after_retention,
    "unregister_stores": unregister_stores,
    "file_validation": file_validation,
    "load_outcome": load_outcome,
    "load_store": load_store,
    "committed_loads": committed_loads,
    "corpus_files": corpus_files,
    "upload_inputs": upload_inputs,
    "store_stats": store_stats,
    "fetch_outcomes": fetch_outcomes,
    "fetch_run_stats": fetch_run_stats,
    "crawl_bfs": crawl_bfs,
    "crawl_registry": crawl_registry,
    "crawl_scoped": crawl_scoped,
    "crawl_run_stats": crawl_run_stats,
    "crawl_run_errors": crawl_run_errors,
    "scan_renders": scan_renders,
    "render_fallback": render_fallback,
    "bundle_blocks": bundle_blocks,
    "crawl_to_bundles": crawl_to_bundles,
    "bundle_roundtrip": bundle_roundtrip,
    "pages_per_doc_type": pages_per_doc_type,
    "markdown_pages": markdown_pages,
    "markdown_text": markdown_text,
    "chunk_documents": chunk_documents,
    "retrieve_lexical": retrieve_lexical,
    "retrieve_vector": retrieve_vector,
    "assemble_context": assemble_context,
    "answer_prompts": answer_prompts,
    "stream_page_features": stream_page_features,
    "stream_recrawl": stream_recrawl,
}
