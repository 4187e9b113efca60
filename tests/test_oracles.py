"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

from textlab.plans import catalog
from textlab.plans.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, key, catalog.queries()[key], catalog.oracle_sql().get(key), SF)
    assert res["status"] in ("OK", "rows-only"), res


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 1 and "accuracy" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
