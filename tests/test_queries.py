import os

import pytest
from compare import compare, duck

from tableslice.plans.registry import Sample, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, con, name):
    fn, sql = all_queries()[name]
    assert sql is not None
    assert compare(fn(Sample(spark, FOLDER)), con, sql) is None


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["table"]: r["rows"] for r in entry.entry(spark).collect()}
    assert rows["orders"] == 200 and rows["region"] == 5
    assert set(all_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())
