"""Dependency graphs: load order, levels, cycles, reachability.

A graph is an edge DataFrame ``child, parent`` (the child refers to the
parent).  The loops checkpoint every round and carry only what is left to do.
``load_order`` works on declared specs, whose number is that of the tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..spec import SchemaSpec
from .components import between_cycles
from .levels import longest_levels


def fk_edges(spark: SparkSession, schema: SchemaSpec) -> DataFrame:
    """One row per declared foreign key: ``child, parent, deferrable``."""
    return spark.createDataFrame(
        [(n, f.references, f.deferrable) for n, t in schema.tables.items() for f in t.foreign_keys],
        "child string, parent string, deferrable boolean",
    )


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges that constrain an order: no self-references, both ends selected.

    Several references between one pair count as one, deferrable if all are.
    """
    if "deferrable" not in edges.columns:
        edges = edges.withColumn("deferrable", F.lit(False))
    out = (
        edges.filter(F.col("child") != F.col("parent"))
        .groupBy("child", "parent").agg(F.bool_and("deferrable").alias("deferrable"))
    )
    if nodes is not None:
        for end in ("child", "parent"):
            out = out.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return out


def _nodes_of(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    )


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, level``: parents stand on lower levels than their children.

    Nodes on a cycle, and those behind one, get a NULL level.
    """
    if nodes is None:
        nodes = _nodes_of(edges)
    nodes = nodes.select("node").distinct()
    plain = clean_edges(edges, nodes).select(F.col("parent").alias("u"), F.col("child").alias("v"))
    return longest_levels(plain, nodes).select("node", F.col("level").cast("int").alias("level"))


def cycle_members(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes on a cycle or between two, and whether all edges there defer.

    What remains when nodes without a parent are peeled off, and then nodes
    without a child.  ``components.strong_components`` tells the cycles apart.
    """
    every = cut(clean_edges(edges, nodes))
    kept = between_cycles(every.select(F.col("child").alias("u"), F.col("parent").alias("v")))
    left = every
    for end in ("child", "parent"):
        left = left.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    ends = left.select(F.col("child").alias("node"), "deferrable").unionByName(
        left.select(F.col("parent").alias("node"), "deferrable")
    )
    return ends.groupBy("node").agg(F.bool_and("deferrable").alias("all_deferrable"))


#: Rounds' finds that are read side by side before they are written as one.
_SIDE_BY_SIDE = 6


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "parents",
              depth: int | None = None) -> DataFrame:
    """``node, distance`` of everything reachable from ``seeds``.

    ``depth`` bounds the steps; a node keeps its first, smallest distance.
    Without a bound, and where no node has two ways on, steps double from round
    to round.  Else a round follows the nodes found by the last one; what has
    been found is written together every few rounds, so that plans stay small.
    """
    near, far = ("child", "parent") if direction == "parents" else ("parent", "child")
    step = cut(edges.filter(F.col("child") != F.col("parent")).select(
        F.col(near).alias("node"), F.col(far).alias("next")
    ).distinct())
    seen = cut(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    if depth is None and step.groupBy("node").count().filter("count > 1").isEmpty():
        return _doubling(step, seen)
    found, frontier, at = [seen], seen, 0
    while depth is None or at < depth:
        at += 1
        new = step.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        for known in found:
            new = new.join(known.select("node"), "node", "left_anti")
        frontier = cut(new.withColumn("distance", F.lit(at)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        if len(found) > _SIDE_BY_SIDE:
            found = [cut(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def _doubling(jump: DataFrame, seen: DataFrame) -> DataFrame:
    """``jump`` leads ``2 ** k`` steps on in round ``k``, and ``seen`` holds all nodes nearer than that.

    Both sides of the joins are of the size of the graph, and there are many
    rounds: a broadcast in each would bring the graph to the driver many times.
    """
    length, before = 1, seen.count()
    while True:
        on = seen.join(jump.hint("merge"), "node").select(F.col("next").alias("node"), (F.col("distance") + length).alias("distance"))
        seen = cut(seen.unionByName(on).groupBy("node").agg(F.min("distance").alias("distance")))
        now = seen.count()
        if now == before:
            return seen
        before, length = now, 2 * length
        ahead = jump.select(F.col("node").alias("next"), F.col("next").alias("later"))
        jump = cut(jump.join(ahead.hint("merge"), "next").select("node", F.col("later").alias("next")))


def relatives(edges: DataFrame, named: DataFrame, with_children: bool = False,
              depth: int | None = None, with_parents: bool = True) -> DataFrame:
    """Tables to take along, and why: ``named``, ``child(n)`` or ``parent``.

    Children come first and parents are then followed from all of them; the
    first reason a node is reached by is the one it keeps.
    """
    out = named.select("node").distinct().withColumn("why", F.lit("named"))
    if with_children:
        down = reachable(edges, named, "children", depth).filter("distance > 0")
        out = out.unionByName(down.select(
            "node", F.format_string("child(%d)", F.col("distance")).alias("why")
        ))
    if with_parents:
        up = reachable(edges, out, "parents").filter("distance > 0")
        out = out.unionByName(up.select("node", F.lit("parent").alias("why")))
    return out


@dataclass(frozen=True)
class LoadOrder:
    tables: list[str]
    cyclic: list[str]
    all_deferrable: bool

    def reversed(self) -> list[str]:
        """Delete order: children before parents."""
        return self.tables[::-1]


def load_order(schema: SchemaSpec, selected: Iterable[str]) -> LoadOrder:
    """Parents before children, ties by name, tables on or behind a cycle last."""
    nodes = sorted(set(selected))
    parents = {
        n: {
            f.references for f in (schema.tables[n].foreign_keys if n in schema.tables else ())
            if f.references in nodes and f.references != n
        }
        for n in nodes
    }
    # Leave out what never becomes free, then let graphlib release the rest.
    free: set[str] = set()
    while more := {n for n in nodes if n not in free and parents[n] <= free}:
        free |= more
    sorter = TopologicalSorter({n: parents[n] for n in free})
    sorter.prepare()
    ready = list(sorter.get_ready())
    heapq.heapify(ready)
    order = []
    while ready:
        node = heapq.heappop(ready)
        order.append(node)
        sorter.done(node)
        for n in sorter.get_ready():
            heapq.heappush(ready, n)
    stuck = [n for n in nodes if n not in free]
    defer = all(
        f.deferrable for n in stuck for f in schema.tables[n].foreign_keys
        if f.references in stuck and f.references != n
    )
    return LoadOrder(order + stuck, stuck, bool(stuck) and defer)
