import math

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tableslice.llm import bitslice
from tableslice.llm.queries import all_queries


@pytest.mark.parametrize("scale", [3, 300, 100_000])
def test_index_equals_brute_force(scale):
    rng = np.random.default_rng(scale)
    ids = rng.permutation(700)
    rows = np.floor(rng.normal(0, scale, (700, 9))).astype(np.int64)
    rows[50:80] = rows[50]  # ties
    index = bitslice.Index(ids, rows)
    got = {q: list(zip(r.tolist(), s.tolist())) for q, r, s in index.top(ids[:70], rows[:70], 5)}
    for q, vector in zip(ids[:70], rows[:70]):
        scores = sorted((-int(r @ vector), i) for i, r in zip(ids.tolist(), rows) if i != q)
        assert got[q] == [(i, -s) for s, i in scores[:5]]


def test_query_agrees_with_sql(spark, spread):
    query, sql = all_queries()["op6_bitsliced_top"]
    assert compare(query(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), sql) is None


def test_odd_vectors(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [-1.0, 0.5]), (9, [1e30, 0.0]),
            (50, [1.0, 1.0]), (51, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score)
           for r in bitslice.exact_top(vectors, F.col("vec_id") % 50 == 0, 3).collect()}
    assert got == {(0, 1): (50, 3 * 256 * 256), (0, 2): (51, 3 * 256 * 256), (0, 3): (1, 0),
                   (50, 1): (0, 3 * 256 * 256), (50, 2): (0, 3 * 256 * 256), (50, 3): (51, 2 * 256 * 256)}
    assert bitslice.exact_top(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_wide_integers_take_part(spark):
    """Beyond the bits that are sliced, as queries and as candidates."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(120)] + [(200, [600_000.0, 1.0, -2.5, 0.0]), (201, [-7e9, 3.0, 1.0, 1.0]),
            (202, [600_000.0, 1.0, -2.5, 0.0]), (250, [1e14, -1e-20, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * v) for v in x] for i, x in rows}
    got = {}
    for r in bitslice.exact_top(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q in (0, 50, 100, 200, 250):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)
        want[q] = [(i, -s) for s, i in scores if abs(s) < 2**63][:5]
    assert got == want
