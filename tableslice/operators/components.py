"""Connected and strongly connected components, in rounds that grow with the logarithm of the nodes.

Both shrink the graph inside tasks first and write what is left to the shared
folder each round.  A strongly connected component is looked for by raking
(nodes without a way in, or out, are alone) and compressing (a node with one way
in and one way out is left out of its chain, and settled once the chain's ends
are), so that chains and trees vanish in a logarithm of rounds; what remains is
settled in one task where it is small and by colours where it is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Edges a task links up among themselves before they are shuffled.
LOCAL_EDGES = 1 << 20
#: Edges of a graph that one task may settle alone.
SMALL_GRAPH = 500_000
#: A round of contraction that leaves more than this share of the edges was the last.
STALLED = 0.9


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``n`` positions linked by ``a[i]`` and ``b[i]`` the smallest position each is connected to."""
    to = np.arange(n)
    while len(a):
        np.minimum.at(to, np.maximum(to[a], to[b]), np.minimum(to[a], to[b]))
        while not np.array_equal(to, jumped := to[to]):
            to = jumped
        apart = to[a] != to[b]
        a, b = a[apart], b[apart]
    return to


def _linked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: every node to the smallest one it is connected to here."""
    held, count = [], 0

    def stars():
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = _smallest(len(ids), at[:len(a)], at[len(a):])
        far = root != np.arange(len(ids))
        return pa.record_batch([pa.array(ids[far]), pa.array(ids[root[far]])], names=["u", "v"])

    for batch in batches:
        held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
        count += batch.num_rows
        if count >= LOCAL_EDGES:
            yield stars()
            held, count = [], 0
    if count:
        yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node with an edge to another; root is the smallest node of its component.

    Nodes are whole numbers; direction, repeats, nulls and self-references do
    not count.  A round ties every node's larger neighbours to the smallest node
    it sees, and then its smaller ones.  Minima are combined before the shuffle,
    so a node that most edges touch is one row after it.
    """
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    links = cut(links.mapInArrow(_linked_up, "u long, v long"))
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v")))
        links = cut(down.filter("u != v").distinct().mapInArrow(_linked_up, "u long, v long").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- contraction ---------------------------------------------------------------


def _round(left: DataFrame, turn: int, keep_loops: bool) -> tuple[DataFrame, DataFrame]:
    """Rake and compress once: the edges left, and the nodes gone with their chain's ``before`` and ``after``."""
    outs = left.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("v").alias("after"))
    ins = left.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("u").alias("before"))
    def place(c):
        return F.xxhash64(F.col(c), F.lit(turn))
    raked = F.col("outs").isNull() | F.col("ins").isNull()
    # Of neighbours in a chain the one placed highest goes, so none goes beside another.
    chained = (F.col("outs") == 1) & (F.col("ins") == 1) & (place("node") > place("before")) & (place("node") > place("after"))
    gone = cut(
        outs.join(ins, "node", "full_outer").filter(raked | chained)
        .select("node", F.when(~raked, F.col("before")).alias("before"), F.when(~raked, F.col("after")).alias("after"))
    )
    bridges = gone.filter("before IS NOT NULL").select(F.col("before").alias("u"), F.col("after").alias("v"))
    def without(df, nodes):
        for end in ("u", "v"):
            df = df.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
        return df
    new = without(left, gone).unionByName(without(bridges, gone)).distinct()
    return cut(new if keep_loops else new.filter("u != v")), gone


def _contract(left: DataFrame, keep_loops: bool, enough: Callable[[int, int], bool]) -> tuple[DataFrame, int, list[DataFrame]]:
    """Rounds until nothing goes any more or ``enough(edges before, edges left)``: edges left, how many, rounds' nodes."""
    removed: list[DataFrame] = []
    count = left.count()
    while count and not (count <= SMALL_GRAPH or removed and enough(before, count)):
        before = count
        left, gone = _round(left, len(removed), keep_loops)
        if gone.isEmpty():
            break
        removed.append(gone)
        count = left.count()
    return left, count, removed


def _one_task(edges: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray], np.ndarray], kind: T.DataType) -> DataFrame:
    """``node, to`` for a graph one task may settle; ``solve`` sees positions and gives a position or -1 for each."""
    def run(group: pa.Table) -> pa.Table:
        n = group.num_rows
        coded = pa.chunked_array([*group["u"].chunks, *group["v"].chunks]).combine_chunks().dictionary_encode()
        ids, at = coded.dictionary, coded.indices.to_numpy()
        to = solve(len(ids), at[:n], at[n:])
        on = to >= 0
        return pa.table({"node": ids.filter(pa.array(on)), "to": ids.take(pa.array(to[on]))})

    schema = T.StructType([T.StructField("node", kind), T.StructField("to", kind)])
    # Few rows, so one partition as well as one group.
    return edges.select("u", "v", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, schema)


def _by_start(n: int, u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each node's successors begin, and the successors."""
    order = np.argsort(u, kind="stable")
    return np.searchsorted(u[order], np.arange(n + 1)).tolist(), v[order].tolist()


def _strong(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A node of its strongly connected component for each node: depth first, by lowest reachable number."""
    begin, follow = _by_start(n, u, v)
    number, low, to = [0] * n, [0] * n, [-1] * n
    place, seen, stack = begin[:-1], 0, []
    for start in range(n):
        if number[start]:
            continue
        path = [start]
        while path:
            x = path[-1]
            if not number[x]:
                seen += 1
                number[x] = low[x] = seen
                stack.append(x)
            if place[x] < begin[x + 1]:
                y = follow[place[x]]
                place[x] += 1
                if not number[y]:
                    path.append(y)
                elif to[y] < 0:
                    low[x] = min(low[x], number[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == number[x]:
                while True:
                    y = stack.pop()
                    to[y] = x
                    if y == x:
                        break
    return np.array(to)


def _between(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Nodes left when those without a way in, and then those without a way out, are taken off; -1 for others."""
    on = np.ones(n, bool)
    for a, b in ((u, v), (v, u)):
        begin, follow = _by_start(n, a, b)
        live = on[u] & on[v]
        waits = np.bincount(b[live], minlength=n)
        ready = np.flatnonzero(on & (waits == 0)).tolist()
        waits = waits.tolist()
        while ready:
            x = ready.pop()
            on[x] = False
            for y in follow[begin[x]:begin[x + 1]]:
                waits[y] -= 1
                if waits[y] == 0 and on[y]:
                    ready.append(y)
    return np.where(on, np.arange(n), -1)


def _spread(edges: DataFrame, start: DataFrame, near: str, far: str) -> DataFrame:
    """Each node's largest ``color`` over the ways to it, within the color where ``start`` has one (``bound``)."""
    state = start
    while True:
        sent = edges.join(state.select(F.col("node").alias(near), "color"), near).groupBy(F.col(far).alias("node")).agg(
            F.max("color").alias("sent"))
        state = cut(state.join(sent, "node", "left").select(
            "node", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("grew")))
        if state.filter("grew").isEmpty():
            return state.drop("grew")
        state = state.drop("grew")


def _by_colors(edges: DataFrame) -> DataFrame:
    """``node, to`` of one strongly connected component per color, where a color is the largest node that reaches it."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    colors = _spread(edges, nodes.select("node", F.col("node").alias("color")), "u", "v")
    at = colors.select(F.col("node").alias("u"), F.col("color").alias("cu"))
    to = colors.select(F.col("node").alias("v"), F.col("color").alias("cv"))
    inside = cut(edges.join(at, "u").join(to, "v").filter("cu = cv").select("u", "v"))
    found = cut(colors.filter("node = color"))
    fresh = found
    while True:  # against the edges, from each color's own node
        back = inside.join(fresh.select(F.col("node").alias("v"), "color"), "v").select(F.col("u").alias("node"), "color").distinct()
        fresh = cut(back.join(found.select("node"), "node", "left_anti"))
        if fresh.isEmpty():
            return found.select("node", F.col("color").alias("to"))
        found = cut(found.unionByName(fresh))


def _all_nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    every = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    return (every if nodes is None else every.union(nodes.select("node"))).distinct()


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component, size``: nodes that reach each other, named by the smallest of them.

    ``edges`` has ``child, parent``; nulls are no nodes and self-references do
    not count.  ``nodes`` adds nodes without an edge; every node has a row.
    """
    plain = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    kind = plain.schema["u"].dataType
    every = _all_nodes(plain, nodes).filter("node IS NOT NULL")
    left = cut(plain.filter("u != v").distinct())
    removed: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        left, count, gone = _contract(left, False, lambda before, now: now > STALLED * before)
        removed += gone
        if count <= SMALL_GRAPH:
            if count:
                found.append(cut(_one_task(left, _strong, kind)))
            break
        some = cut(_by_colors(left))
        found.append(some)
        for end in ("u", "v"):
            left = left.join(some.select(F.col("node").alias(end)), end, "left_anti")
        left = cut(left)
    known = reduce(DataFrame.unionByName, found) if found else every.limit(0).select("node", F.col("node").alias("to"))
    for gone in reversed(removed):  # in a chain: where its two ends are
        chains = gone.filter("before IS NOT NULL")
        for end in ("before", "after"):
            at = known.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
            chains = chains.join(at, end, "left").withColumn(f"{end}_to", F.coalesce(f"{end}_to", end))
        known = cut(known.unionByName(chains.filter("before_to = after_to").select("node", F.col("before_to").alias("to"))))
    named = every.join(known, "node", "left").select("node", F.coalesce("to", "node").alias("to"))
    least = named.groupBy("to").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return named.join(least, "to").select("node", "component", "size")


def between_cycles(edges: DataFrame) -> DataFrame:
    """``node`` of those on a cycle or on a way from one cycle to another; ``edges`` has ``u, v``, no two equal."""
    kind = edges.schema["u"].dataType
    left, count, removed = _contract(cut(edges), True, lambda before, now: False)
    if 0 < count <= SMALL_GRAPH:
        kept = cut(_one_task(left, _between, kind).select("node"))
    else:  # nothing to rake any more: all that is left stays
        kept = cut(left.select(F.col("u").alias("node")).union(left.select("v")).distinct())
    for gone in reversed(removed):
        chains = gone.filter("before IS NOT NULL")
        for end in ("before", "after"):
            chains = chains.join(kept.select(F.col("node").alias(end)), end, "left_semi")
        kept = cut(kept.unionByName(chains.select("node")))
    return kept
