"""Fetch and render outcomes (P15, P16) and the render fallback.

The network is not part of the engine: fetches arrive as a page table with
an HTTP ``status`` (and ``error_kind`` for network errors / timeouts), and
browser renders as a ``renders`` table keyed by url.  These jobs turn those
into outcome columns and pick the content each page continues with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_outcome(status: F.Column, url: F.Column, error_kind: F.Column | None = None,
                  error_detail: F.Column | None = None) -> F.Column:
    """struct(ok BOOLEAN, error STRING) for one fetch."""
    kind = error_kind if error_kind is not None else F.lit(None).cast("string")
    detail = error_detail if error_detail is not None else F.lit("connection failed")
    err = (F.when(kind == "timeout", F.concat(F.lit("Timeout while fetching "), url))
           .when(kind == "network", F.concat(F.lit("Network error while fetching "), url, F.lit(": "), detail))
           .when(status == 200, F.lit(None))
           .when(status == 404, F.concat(F.lit("Page not found (404): "), url))
           .when(status == 403, F.concat(F.lit("Access forbidden (403): "), url))
           .when(status == 429, F.concat(F.lit("Rate limit exceeded (429): "), url))
           .when(status >= 500, F.concat(F.lit("Server error ("), status.cast("string"), F.lit("): "), url))
           .otherwise(F.concat(F.lit("HTTP error ("), status.cast("string"), F.lit("): "), url)))
    return F.struct(err.isNull().alias("ok"), err.alias("error"))


def render_outcome(status: F.Column, success: F.Column, markdown: F.Column, first_error: F.Column) -> F.Column:
    """struct(ok, markdown, error) for one render response."""
    err = (F.when(status == 429, F.lit("Render rate limit exceeded"))
           .when(status.isin(401, 403), F.concat(F.lit("Render authentication failed ("), status.cast("string"),
                                                 F.lit(")")))
           .when((status == 200) & F.coalesce(success, F.lit(False)), F.lit(None))
           .otherwise(F.coalesce(first_error, F.lit("Unknown error"))))
    ok = err.isNull()
    return F.struct(ok.alias("ok"), F.when(ok, F.coalesce(markdown, F.lit(""))).alias("markdown"),
                    err.alias("error"))


def scan_renders(responses: DataFrame) -> DataFrame:
    """SRC5: responses(request_url, status, success, markdown, url, timestamp,
    error) -> (url, status, success, markdown, timestamp, error) with the
    defaults of a response: of a good one no markdown and no time are empty
    and no url is the request's; any other has no markdown, no time and the
    request's url."""
    good = (F.col("status") == 200) & F.coalesce(F.col("success"), F.lit(False))
    return responses.select(
        F.when(good, F.coalesce("url", "request_url")).otherwise(F.col("request_url")).alias("url"), "status", good.alias("success"),
        F.when(good, F.coalesce("markdown", F.lit(""))).otherwise(F.lit("")).alias("markdown"),
        F.when(good, F.coalesce("timestamp", F.lit(""))).otherwise(F.lit("")).alias("timestamp"),
        F.when(~good, F.coalesce("error", F.lit("Unknown error"))).alias("error"))


def good_renders(pages: DataFrame, renders: DataFrame) -> DataFrame:
    """J8 for pages(page_id, url, is_dynamic) that are kept without their html:
    (page_id, url, markdown) of the dynamic pages whose render succeeded."""
    r = renders.select(F.col("url").alias("_rurl"), render_outcome(F.col("status"), F.col("success"), F.col("markdown"), F.col("error")).alias("_r"))
    return (pages.where("is_dynamic").join(r.where("_r.ok"), F.col("url") == F.col("_rurl"))
            .select("page_id", "url", F.col("_r.markdown").alias("markdown")))


def render_fallback(pages: DataFrame, renders: DataFrame | None, renderer_available: bool = True) -> DataFrame:
    """pages(page_id, url, html, is_dynamic) [x renders(url, status, success,
    markdown, error)] -> content per page.

    A dynamic page uses its rendered markdown when a renderer is available
    and the render succeeded; on a failed or missing render it falls back to
    the fetched html (the documented fallback).  Static pages never use the
    renderer.  ``content_kind`` says which one was kept: rendered markdown
    has no links, so such a page is a crawl leaf.
    """
    use = F.col("is_dynamic") & F.lit(bool(renderer_available))
    if renders is None:
        j = pages.withColumn("_r", F.lit(None).cast("struct<ok:boolean,markdown:string,error:string>"))
    else:
        r = renders.select(F.col("url").alias("_rurl"),
                           render_outcome(F.col("status"), F.col("success"), F.col("markdown"),
                                          F.col("error")).alias("_r"))
        # one left join; only dynamic pages match (the flag is part of the
        # condition).  Spark broadcasts the renders where they are small, so
        # the wide html column is then not shuffled
        j = pages.join(r, (F.col("url") == F.col("_rurl")) & use, "left").drop("_rurl")
    rendered = use & F.coalesce(F.col("_r.ok"), F.lit(False))
    state = (F.when(~F.col("is_dynamic"), F.lit("not_needed"))
             .when(F.lit(not renderer_available), F.lit("unavailable"))
             .when(F.col("_r").isNull(), F.lit("missing"))
             .when(rendered, F.lit("rendered"))
             .otherwise(F.lit("fallback")))
    others = [c for c in pages.columns if c not in ("html",)]
    return j.select(
        *others, state.alias("render_state"),
        F.when(rendered, F.col("_r.markdown")).otherwise(F.col("html")).alias("content"),
        F.when(rendered, F.lit("markdown")).otherwise(F.lit("html")).alias("content_kind"),
        F.col("_r.error").alias("render_error"),
    )
