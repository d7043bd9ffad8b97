"""Plan properties that matter at scale."""
import re

import __spark_entry__ as E
from quire.operators import stores as S
from quire.plans import derive as D

from .conftest import SF_SMALL, formatted


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + df._jdf.queryExecution().optimizedPlan().toString()


def exchange_inputs(df, keyed_only: bool = True) -> list[str]:
    """Column lists of the Exchanges in the formatted plan.  ``keyed_only``
    skips round-robin exchanges: those only deal an under-split scan out
    over the cores (tables.spread) and never exist for a large input."""
    txt = formatted(df)
    out = []
    for block in re.findall(r"\(\d+\) (?:Exchange|ShuffleExchange)[^\n]*\n((?:[A-Z][^\n]*\n?)+)", txt):
        m = re.search(r"Input \[\d+\]: \[([^\]]*)\]", block)
        if m and not (keyed_only and "RoundRobinPartitioning" in block):
            out.append(m.group(1))
    return out


def test_html_not_read_when_not_needed(spark):
    for name in ("url_parts", "infer_doc_type", "resolve_keywords"):
        txt = formatted(E.queries()[name](spark, SF_SMALL))
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", txt)
        assert schemas and all("html" not in s for s in schemas), (name, schemas)


def test_html_never_shuffled(spark):
    seen = 0
    for name in ("page_features", "site_render_needs", "page_links", "render_fallback", "bundle_blocks"):
        df = E.queries()[name](spark, SF_SMALL)
        for cols in exchange_inputs(df):
            seen += 1
            assert not re.search(r"\bhtml#", cols), (name, cols)
    assert seen >= 2  # the check looked at real (keyed) shuffles


def test_spread_only_for_under_split_scans(spark):
    from quire.sources.tables import spread

    small = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    assert small.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" in formatted(spread(small))
    many = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism * 2)
    assert spread(many) is many


def test_latest_store_is_partial_aggregate_not_window(spark):
    txt = formatted(S.latest_store(D.stores(spark, SF_SMALL)))
    assert "HashAggregate" in txt or "ObjectHashAggregate" in txt or "SortAggregate" in txt
    assert "Window" not in txt


def test_render_lookup_is_broadcast(spark):
    txt = formatted(E.queries()["render_fallback"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in txt


def test_filters_pushed_to_scan(spark):
    txt = formatted(E.queries()["assemble_context"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*role", txt), txt[:2000]


def test_no_cartesian_products(spark):
    for name, fn in E.queries().items():
        if name == "stream_page_features" or name.startswith("op") or name == "pipeline":
            continue
        txt = formatted(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt, name
