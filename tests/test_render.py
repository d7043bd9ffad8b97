"""P15 fetch outcomes, P16 render outcomes, J8 render fallback."""
from pyspark.sql import functions as F

from quire.operators.render import fetch_outcome, render_fallback, render_outcome


def test_fetch_outcomes(spark):
    rows = [(200, None), (404, None), (403, None), (429, None), (500, None), (302, None), (200, "network"),
            (None, "timeout")]
    df = spark.createDataFrame(rows, "status int, kind string").withColumn("url", F.lit("https://h/p"))
    got = [r.o for r in df.select(fetch_outcome(F.col("status"), F.col("url"), F.col("kind")).alias("o")).collect()]
    assert got[0].ok and got[0].error is None
    assert got[1].error == "Page not found (404): https://h/p"
    assert got[2].error == "Access forbidden (403): https://h/p"
    assert got[3].error == "Rate limit exceeded (429): https://h/p"
    assert got[4].error == "Server error (500): https://h/p"
    assert got[5].error == "HTTP error (302): https://h/p"
    assert got[6].error.startswith("Network error while fetching https://h/p")
    assert got[7].error == "Timeout while fetching https://h/p"


def test_render_outcomes(spark):
    rows = [(200, True, "# md", None), (200, True, None, None), (429, False, None, None), (401, False, None, None),
            (200, False, None, "Bad page"), (500, False, None, None)]
    df = spark.createDataFrame(rows, "status int, success boolean, markdown string, error string")
    got = [r.o for r in df.select(render_outcome(F.col("status"), F.col("success"), F.col("markdown"),
                                                 F.col("error")).alias("o")).collect()]
    assert (got[0].ok, got[0].markdown) == (True, "# md")
    assert (got[1].ok, got[1].markdown) == (True, "")
    assert got[2].error == "Render rate limit exceeded"
    assert got[3].error == "Render authentication failed (401)"
    assert got[4].error == "Bad page"
    assert got[5].error == "Unknown error"


def test_render_fallback(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>1</p>", True), (2, "u2", "<p>2</p>", True),
                                   (3, "u3", "<p>3</p>", True), (4, "u4", "<p>4</p>", False)],
                                  "page_id int, url string, html string, is_dynamic boolean")
    renders = spark.createDataFrame([("u1", 200, True, "# one", None), ("u2", 429, False, None, None),
                                     ("u4", 200, True, "# four", None)],
                                    "url string, status int, success boolean, markdown string, error string")
    got = {r.page_id: (r.render_state, r.content_kind, r.content) for r in render_fallback(pages, renders).collect()}
    assert got == {1: ("rendered", "markdown", "# one"), 2: ("fallback", "html", "<p>2</p>"),
                   3: ("missing", "html", "<p>3</p>"), 4: ("not_needed", "html", "<p>4</p>")}
    off = {r.page_id: r.render_state for r in render_fallback(pages, renders, renderer_available=False).collect()}
    assert off[1] == "unavailable" and off[4] == "not_needed"
