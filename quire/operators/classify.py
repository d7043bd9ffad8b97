"""Page classification (P8-P12): static vs script-rendered pages.

``page_features`` is one narrow projection over the page table: regexes and
string functions only, so it runs inside whole-stage codegen and never
shuffles the wide ``html`` column.  ``site_render_needs`` then aggregates the
slim feature rows per host with partial (map-side) aggregation, so a host
holding a third of all pages costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import urls as U


def page_features(pages: DataFrame, html_col: str = "html", **extra: Column) -> DataFrame:
    """Per page: host, lengths, text ratio, detected frameworks, dynamic flag,
    and what ``extra`` names, from the same pass over the page.

    Input: ``page_id, url, html``.  ``frameworks`` is the ordered list joined
    by ','; ``is_dynamic`` = frameworks found AND ratio < 0.1 (strict).
    """
    h = F.col(html_col)
    vt = H.visible_text(h)
    feats = pages.select(
        "page_id",
        U.url_netloc("url").alias("host"),
        F.length(h).cast("bigint").alias("html_len"),
        F.length(vt).cast("bigint").alias("text_len"),
        H.framework_list(h).alias("frameworks"),
        *(column.alias(name) for name, column in extra.items()),
    )
    ratio = H.ratio_of("text_len", "html_len")
    return feats.select(
        "page_id",
        "host",
        "html_len",
        "text_len",
        ratio.alias("text_ratio"),
        "frameworks",
        (F.coalesce(F.col("frameworks") != "", F.lit(False)) & (ratio < F.lit(H.TEXT_RATIO_THRESHOLD))).alias("is_dynamic"),
        *extra,
    )


def with_dynamic_flag(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All input columns plus ``is_dynamic`` -- one projection, so callers that
    keep ``html`` (render fallback) never join it back."""
    h = F.col(html_col)
    return pages.withColumn("is_dynamic", F.coalesce(H.framework_list(h) != "", F.lit(False)) & (H.text_ratio(h) < F.lit(H.TEXT_RATIO_THRESHOLD)))


def site_render_needs(features: DataFrame) -> DataFrame:
    """Per host: how many pages need rendering ("which sites need a browser?")."""
    return features.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("is_dynamic").alias("n_dynamic"),
        F.count_if(~F.col("is_dynamic")).alias("n_static"),
        F.count_if(F.col("frameworks") != "").alias("n_with_framework"),
        F.sum("text_len").alias("text_chars"),
        F.sum("html_len").alias("html_chars"),
        F.try_divide(F.sum("text_len"), F.sum("html_len")).alias("site_text_ratio"),
    )
