"""Levels and reachability against plain walks, with contraction rounds and without."""

import random

import pytest

from tableslice import session
from tableslice.operators import components, graph, levels
from test_components import reach


def plain_levels(edges, nodes):
    parents = {n: {a for a, b in edges if b == n} for n in nodes}
    level, grew = {}, True
    while grew:
        ready = [n for n in nodes if n not in level and all(p in level for p in parents[n])]
        grew = bool(ready)
        level.update({n: max((level[p] + 1 for p in parents[n]), default=0) for n in ready})
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("small", [500_000, 0])
def test_levels_like_a_walk(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_GRAPH", small)
    pick = random.Random(small)
    edges = [(a, a + pick.randrange(1, 9)) for a in range(40) for _ in range(2)]
    edges += [(100 + i, 101 + i) for i in range(50)] + [(105, 130), (3, 120), (149, 200), (200, 201), (202, 201)]
    edges += [(300, 301), (301, 302), (302, 300), (302, 303), (303, 304), (305, 304), (400, 401), (401, 400)]
    nodes = {x for e in edges for x in e} | {999}
    df = spark.createDataFrame([*edges, *edges[:9], (5, 5)], "parent long, child long")
    got = graph.dependency_levels(df, spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["level"] for r in got.collect()} == plain_levels(set(edges), nodes)
    assert got.count() == len(nodes)


def test_a_deep_chain_writes_little(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(components, "SMALL_GRAPH", 100)
    written = []
    for module in (components, levels):
        real = session.cut
        def counted(df, real=real):
            out = real(df)
            written.append(out)
            return out
        monkeypatch.setattr(module, "cut", counted)
    edges = spark.range(5000).selectExpr("id AS u", "id + 1 AS v")
    got = levels.longest_levels(edges, spark.range(5001).withColumnRenamed("id", "node"))
    assert got.filter("node = level").count() == 5001
    lefts = [df.count() for df in written if df.columns == ["u", "v", "w"]]
    assert sum(lefts[1:]) <= 3 * 5000 and len(lefts) <= 20


def test_a_deep_chain_with_skips_takes_few_rounds(spark, monkeypatch):
    """No node between has one way in and one out, so each round used to take off a source and a sink."""
    monkeypatch.setattr(components, "SMALL_GRAPH", 600)
    written = []
    def counted(df):
        written.append(df)
        assert len(written) < 100
        return session.cut(df)
    monkeypatch.setattr(levels, "cut", counted)
    edges = spark.range(1000).selectExpr("id AS parent", "id + 1 AS child")
    edges = edges.union(spark.range(6, 1001).selectExpr("floor(id / 3) AS parent", "id AS child"))
    got = graph.dependency_levels(edges, spark.range(1001).withColumnRenamed("id", "node"))
    assert got.filter("node = level").count() == 1001 == got.count()


def test_doubling_broadcasts_nothing(spark, monkeypatch):
    plans = []
    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.cut(df)
    monkeypatch.setattr(graph, "cut", seen)
    edges = spark.range(1, 200).selectExpr("id AS child", "id - 1 AS parent")
    assert graph.reachable(edges, spark.range(199, 200).withColumnRenamed("id", "node"), "parents").count() == 200
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("single", [True, False])
def test_reachable_like_a_walk(spark, single):
    pick = random.Random(9)
    edges = [(i, pick.randrange(i)) for i in range(1, 120)] + [(500 + i, 501 + i) for i in range(40)] + [(540, 500)]
    if not single:
        edges += [(pick.randrange(120), pick.randrange(120)) for _ in range(40)]
    seeds = [3, 77, 110, 520, 999]
    expected, todo, at = dict.fromkeys(seeds, 0), seeds, 0
    while todo:
        at += 1
        todo = sorted({b for a, b in edges if a in set(todo)} - set(expected))
        expected.update(dict.fromkeys(todo, at))
    assert set(expected) == {x for s in seeds for x in reach(edges)(s)} | set(seeds)
    df, start = spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(s,) for s in seeds], "node long")
    got = {r["node"]: r["distance"] for r in graph.reachable(df, start, "parents").collect()}
    assert got == expected
    near = {r["node"]: r["distance"] for r in graph.reachable(df, start, "parents", depth=2).collect()}
    assert near == {n: d for n, d in expected.items() if d <= 2}
