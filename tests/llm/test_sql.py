"""Queries that SQL can express agree with it, with small sorts left in many partitions."""

import pytest
from compare import compare, duck

from tableslice.llm.queries import all_queries

WITH_SQL = sorted(name for name, (_, sql) in all_queries().items() if sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_agrees_with_sql(spark, spread, name):
    query, sql = all_queries()[name]
    folder = "/root/testdata/sf0.01"
    assert compare(query(spark, folder), duck(folder), sql) is None


def test_links_in_sql(spark):
    """The sample has no close vectors; a few rows with known links show that the SQL sees them."""
    con = duck("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM (VALUES (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1),"
                " (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1)) t(vec_id, embedding, label)")
    rows = sorted(con.execute(all_queries()["op2_nn_descent"][1]).fetchall())
    assert rows == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
