import numpy as np
from pyspark.sql import functions as F

from tableslice.llm import nndescent
from tableslice.llm.shared import roots


def slow(rows, threshold=0.98):
    """n_links and component per row, by comparing all."""
    ok = []
    for vec_id, x, label in rows:
        good = x is not None and label is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
        ok.append(np.array(x, float) / np.linalg.norm(np.array(x, float)) if good else None)
    a, b = [], []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if float(ok[i] @ ok[j]) >= threshold:
                    a.append(i)
                    b.append(j)
    label = roots(len(rows), np.array(a, int), np.array(b, int))
    n = np.bincount(np.array(a, int), minlength=len(rows))
    first = {}
    for (vec_id, _, _), r in zip(rows, label):
        if vec_id is not None:
            first[r] = min(first.get(r, vec_id), vec_id)
    return sorted(((r[0], int(k), first.get(c), r[0] is not None and r[0] == first.get(c))
                   for r, k, c in zip(rows, n, label)), key=str)


def data(seed=0, noise=0.01):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        rows.append((rng.normal(size=16), int(rng.integers(3))))
    for size in (2, 2, 3, 5, 12, 40, 120):
        centre, label = rng.normal(size=16), int(rng.integers(3))
        rows += [(centre + rng.normal(0, noise * 3, 16), label) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i][0].tolist(), rows[i][1]) for k, i in enumerate(order)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("c"))
    return sorted((tuple(r) for r in nndescent.near_duplicates(df).collect()), key=str)


def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 50)
    rows = data()
    want = slow(rows)
    assert max(r[1] for r in want) > nndescent.K
    assert run(spark, rows) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2),
            (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
            (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 2), (None, [0.0, 1.0], 3)]
    assert run(spark, rows) == slow(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nndescent.near_duplicates(empty).collect() == []


def test_audit_sees_missing_links(spark):
    rows = data(3)
    df = spark.createDataFrame(rows, "id long, x array<double>, kind long").withColumn("copies", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "id long, n long")
    assert nndescent.audit(df, none, 0.98) == 0.0
    true = spark.createDataFrame([(r[0], r[1]) for r in slow(rows)], "id long, n long")
    assert nndescent.audit(df, true, 0.98) == 1.0


def test_clusters_of_clusters_lose_no_link(spark):
    """Two tight clusters of 90, near enough to link, fill each other's lists with their own."""
    rng = np.random.default_rng(3)
    center = np.zeros((2, 32))
    center[0, 0] = 1.0
    center[1, :2] = np.cos(0.172), np.sin(0.172)
    x = np.repeat(center, 90, axis=0) + rng.normal(scale=0.0035, size=(180, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    assert near[:90, 90:].mean() > 0.9
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(near[i].sum()) - 1 for i in range(180)}
    assert {r["component_id"] for r in got} == {0}
