"""Link extraction (G1): pages -> distinct (src, dst) edges.

P14 href values -> P3 defrag -> F1 non-empty -> P4 url_join -> F2 same
netloc (scheme not compared) -> F3 path scope -> A4 distinct.

One narrow projection reads ``html`` and emits slim string rows; the only
shuffle is the ``distinct`` on (src, dst), whose keys are pairs and so are
not skewed even when one site holds a third of all pages.

Scope (F3): ``"page"`` (the crawler's rule) keeps a link only when its path,
right-stripped of '/', starts with the linking page's path (plain string
prefix, not segment-aware); ``"site"`` keeps every same-host link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import urls as U


def extract_links(pages: DataFrame, scope: str = "page", src_col: str = "url", html_col: str = "html") -> DataFrame:
    return resolve_links(pages.select(F.col(src_col).alias("src"), F.explode(H.href_values(F.col(html_col))).alias("href")), scope)


def resolve_links(hrefs: DataFrame, scope: str = "page") -> DataFrame:
    """(src, href) as found in the pages -> distinct (src, dst) in scope."""
    if scope not in ("page", "site"):
        raise ValueError("scope must be 'page' or 'site'")
    hrefs = hrefs.select("src", U.defrag("href").alias("href"))
    joined = U.with_url_join(hrefs.where(F.col("href") != ""), "src", "href", "dst", parts=True)
    cond = F.col("dst_netloc") == F.col("src_netloc")
    if scope == "page":
        strip = lambda c: F.regexp_replace(c, r"/+$", "")
        cond = cond & strip(F.col("dst_path")).startswith(strip(F.col("src_path")))
    return joined.where(cond).select("src", "dst").distinct()
