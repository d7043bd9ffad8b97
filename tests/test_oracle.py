"""Every registered query equals its DuckDB oracle (sf0.001, whole tables)."""
import pytest

import __spark_entry__ as E
from quire.plans.check import compare, duck

from .conftest import SF_SMALL

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in SQL:
        assert df.count() > 0
        return
    res = compare(df, con, SQL[name])
    assert res["match"], res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "n_dynamic" in df.columns
