import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("quire-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests own their session: an unset checkpoint dir gets a private folder
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-test-ckpt-"))
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as sorted tuples (of ``cols`` or all columns)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchange_children(spark, df):
    """The scans whose rows an exchange moves (no other exchange or join between), as text."""
    out = []

    def scans(node):
        name = node.nodeName()
        if "Exchange" in name or "Join" in name:
            return []
        own = [node.simpleString(1000)] if "Scan" in name else []
        kids = node.children()
        return own + [s for i in range(kids.size()) for s in scans(kids.apply(i))]

    def walk(node):
        if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.initialPlan())
        kids = node.children()
        for i in range(kids.size()):
            if "Exchange" in node.nodeName():
                out.extend(scans(kids.apply(i)))
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out
