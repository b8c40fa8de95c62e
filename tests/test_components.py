"""Components and first-come merges against plain walks, with every path of the algorithms taken."""

import random

import pytest

from tableslice import session
from tableslice.operators import components, merge
from tableslice.operators.graph import cycle_members
from tableslice.spec import TableSpec, UniqueKey, int_col


def reach(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    def walk(x):
        seen, todo = set(), [x]
        while todo:
            for y in to.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen
    return walk


def graph(seed):
    """Random edges, a long chain with a few ways back, and a tree."""
    pick = random.Random(seed)
    edges = [(pick.randrange(30), pick.randrange(30)) for _ in range(32)]
    chain = [*range(100, 160)]
    pick.shuffle(chain)
    edges += list(zip(chain, chain[1:])) + [(chain[i + 5], chain[i]) for i in range(7, 50, 13)]
    edges += [(200 + i, 200 + i // 2) for i in range(1, 40)] + [(chain[20], 210), (3, 3), (300, 301), (301, 300)]
    return edges


@pytest.mark.parametrize("small", [500_000, 20, 0])
def test_strong_components_like_a_walk(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_GRAPH", small)
    edges = graph(small + 1)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "child long, parent long")
    walk = reach(edges)
    nodes = {x for e in edges for x in e} | {900}
    expected = {}
    for x in nodes:
        mine = {x} | {y for y in walk(x) if x in walk(y)}
        expected[x] = (min(mine), len(mine))
    got = components.strong_components(df, spark.createDataFrame([(900,)], "node long"))
    assert {r["node"]: (r["component"], r["size"]) for r in got.collect()} == expected


@pytest.mark.parametrize("small", [500_000, 0])
def test_between_cycles_like_a_walk(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_GRAPH", small)
    edges = [e for e in graph(3) if e[0] != e[1]]
    up, down = reach(edges), reach([(b, a) for a, b in edges])
    cyclic = {x for e in edges for x in e if x in up(x)}
    expected = {x for e in edges for x in e if (cyclic & (up(x) | {x})) and (cyclic & (down(x) | {x}))}
    got = cycle_members(spark.createDataFrame(edges, "child long, parent long"))
    assert {r["node"] for r in got.collect()} == expected


def test_components_of_text_nodes(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")], "child string, parent string")
    got = {r["node"]: r["component"] for r in components.strong_components(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert components.strong_components(df.limit(0)).count() == 0


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL_GRAPH", 1000)
    rounds = []
    real = components._round
    monkeypatch.setattr(components, "_round", lambda *a: rounds.append(1) or real(*a))
    df = spark.range(100_000).selectExpr("id AS child", "(id + 1) AS parent").unionAll(
        spark.sql("SELECT 70000L AS child, 30000L AS parent"))
    got = components.strong_components(df)
    assert got.filter("size > 1").selectExpr("min(node)", "max(node)", "min(component)", "max(component)", "count(*)").first() \
        == (30000, 70000, 30000, 30000, 40001)
    assert got.count() == 100_001 and len(rounds) <= 14


def test_connected_components(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)]
    walk = reach(edges + [(b, a) for a, b in edges])
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {x: min(walk(x)) for e in edges for x in e if e[0] != e[1]}


SPEC = TableSpec("t", (int_col("id"), int_col("a"), int_col("b"), int_col("c")), ("id",),
                 unique=(UniqueKey(("a",)), UniqueKey(("b", "c"))))


def first_come(rows):
    got, out = set(), []
    for r in sorted(rows):
        wants = {("i", r[0])} | ({("a", r[1])} if r[1] is not None else set()) \
            | ({("b", r[2], r[3])} if None not in r[2:] else set())
        if not wants & got:
            got |= wants
            out.append(r)
    return out


@pytest.mark.parametrize("alone", [1_000_000, 12])
def test_skip_existing_takes_rows_in_order(spark, monkeypatch, alone):
    monkeypatch.setattr(merge, "SETTLED_ALONE", alone)
    pick = random.Random(6)
    some = lambda n: pick.choice([None, *[pick.randrange(n)] * 9])
    rows = [(i, some(60), some(20), some(8)) for i in range(150)] + [(1000 + i, 500, some(20), some(8)) for i in range(40)]
    rows += [(2000 + i, 9000 + i // 2, 9000 + (i + 1) // 2, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long").repartition(4)
    got = merge.merge_skip_existing(df.limit(0), df, SPEC)
    assert sorted(map(tuple, got.collect())) == first_come(rows)


def test_a_chain_of_conflicts_takes_few_writes(spark, monkeypatch):
    writes = []
    for module in (components, merge):
        real = session.cut
        monkeypatch.setattr(module, "cut", lambda df: writes.append(1) or real(df))
    rows = spark.range(10_000).selectExpr("id", "id div 2 AS a", "(id + 1) div 2 AS b", "1L AS c")
    got = merge.merge_skip_existing(rows.limit(0), rows, SPEC)
    assert [r["id"] for r in got.orderBy("id").collect()] == [*range(0, 10_000, 2)]
    assert len(writes) <= 20
