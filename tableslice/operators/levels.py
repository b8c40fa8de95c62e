"""Longest ways from the roots of a dependency graph, in rounds that shrink it.

A round takes off sources (their level is known and passed on), sinks (settled
once their parents are) and inner nodes with few ways in or out, no two of them
side by side (settled from the nodes before them); each way in and each way out
of an inner node become one longer edge, and of equal edges the longest counts.
Chains and trees of any depth, also with edges that skip ahead, so shrink by a
share of what is left in most rounds, and each round writes only that.  The rest
is settled by one task where it is small.  A dense graph, where every node has
many ways in and out, is taken off from its ends only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import components

#: Tables of settled levels that are read side by side before they are written as one.
SIDE_BY_SIDE = 8
#: An inner node may leave this many edges more than it takes off; twice as many
#: after a round that left more than ``STALLED`` of the edges, none after one that added some.
MORE_EDGES, MOST_EDGES, STALLED = 4, 64, 0.95


def _walk(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Level of each position, -1 on a cycle or behind one."""
    order = np.argsort(u, kind="stable")
    begin = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    follow, length = v[order].tolist(), w[order].tolist()
    waits, level = np.bincount(v, minlength=n).tolist(), base.tolist()
    ready = [x for x in range(n) if not waits[x]]
    settled = np.zeros(n, bool)
    while ready:
        x = ready.pop()
        settled[x] = True
        for i in range(begin[x], begin[x + 1]):
            y = follow[i]
            level[y] = max(level[y], level[x] + length[i])
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    return np.where(settled, level, -1)


def _in_one_task(edges: DataFrame, base: DataFrame, kind: T.DataType) -> DataFrame:
    """``node, level`` of a small graph; a row without ``u`` says what ``v`` is at least."""
    def run(group: pa.Table) -> pa.Table:
        on = np.flatnonzero(group["u"].is_valid().to_numpy())
        own = np.flatnonzero(~group["u"].is_valid().to_numpy())
        pick = group.take(pa.array(on))
        coded = pa.chunked_array([*pick["u"].chunks, *pick["v"].chunks]).combine_chunks().dictionary_encode()
        ids, at = coded.dictionary, coded.indices.to_numpy()
        least = np.zeros(len(ids), np.int64)
        given = group.take(pa.array(own))
        place = pc.index_in(given["v"].combine_chunks(), ids).to_numpy(zero_copy_only=False)
        known = ~np.isnan(place.astype(float))
        least[place[known].astype(int)] = given["w"].to_numpy()[known]
        found = _walk(len(ids), at[:len(on)], at[len(on):], pick["w"].to_numpy(), least)
        return pa.table({"node": ids, "level": pa.array(found, mask=found < 0)})

    rows = edges.select("u", "v", "w").unionByName(base.select(
        F.lit(None).cast(kind).alias("u"), F.col("node").alias("v"), F.col("base").alias("w")))
    schema = T.StructType([T.StructField("node", kind), T.StructField("level", T.LongType())])
    return rows.select("*", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, schema)


def _gone(left: DataFrame, base: DataFrame, turn: int, more: int) -> DataFrame:
    """Nodes a round takes off: ``node, what, base``; no two ``inner`` ones have an edge."""
    outs = left.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.bool_or(F.col("u") == F.col("v")).alias("loop"))
    ins = left.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("ins"))
    few = ~F.col("loop") & (F.col("ins") * F.col("outs") <= F.col("ins") + F.col("outs") + more)
    what = F.when(F.col("ins").isNull(), "source").when(F.col("outs").isNull(), "sink").when(few, "inner")
    may = cut(outs.join(ins, "node", "full_outer").select("node", what.alias("what")).filter("what IS NOT NULL"))
    inner = may.filter("what = 'inner'")
    between = left.join(_of(inner, "node", "u"), "u", "left_semi").join(_of(inner, "node", "v"), "v", "left_semi")
    def place(c):
        return F.xxhash64(F.col(c), F.lit(turn))
    beaten = between.select(F.when(place("u") < place("v"), F.col("u")).otherwise(F.col("v")).alias("node")).distinct()
    return cut(may.join(beaten, "node", "left_anti").join(base, "node", "left").select(
        "node", "what", F.coalesce("base", F.lit(0).cast("long")).alias("base")))


def _of(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name))


def longest_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level`` of all ``nodes``: 0 without a parent, else one more than the highest parent's.

    ``edges`` has ``u, v`` (``u`` stands before ``v``), no two equal and none to
    itself.  Nodes on a cycle and those behind one have a null level.
    """
    kind = edges.schema["u"].dataType
    left = cut(edges.select("u", "v", F.lit(1).cast("long").alias("w")))
    base = nodes.limit(0).select(F.col("node"), F.lit(0).cast("long").alias("base"))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    count, more = left.count(), MORE_EDGES
    while count > components.SMALL_GRAPH:
        gone = _gone(left, base, len(rounds), more)
        sources, sinks, inner = (gone.filter(F.col("what") == x) for x in ("source", "sink", "inner"))
        if sources.isEmpty():
            break  # all that is left is on a cycle or behind one
        ends = cut(left.join(gone.filter("what != 'source'").select(F.col("node").alias("v"), "what"), "v").select(
            "u", F.col("v").alias("node"), "w", "what"))
        onward = left.join(inner.select(F.col("node").alias("u"), "base"), "u").select(
            F.col("u").alias("node"), "v", F.col("w").alias("on"), "base")
        bridges = ends.filter("what = 'inner'").drop("what").join(onward, "node").select("u", "v", (F.col("w") + F.col("on")).alias("w"))
        bridges = bridges.join(_of(sinks, "node", "v"), "v", "left_anti").select(*left.columns)
        first = sources.select(F.col("node").alias("u"), "base")
        passed = [
            left.unionByName(bridges).join(first, "u").select(F.col("v").alias("node"), (F.col("base") + F.col("w")).alias("base")),
            onward.filter("base > 0").select(F.col("v").alias("node"), (F.col("base") + F.col("on")).alias("base")),
        ]
        kept = left.join(_of(gone, "node", "u"), "u", "left_anti").join(_of(gone, "node", "v"), "v", "left_anti")
        kept = kept.select(*left.columns).unionByName(bridges.join(_of(sources, "node", "u"), "u", "left_anti").select(*left.columns))
        base = cut(reduce(DataFrame.unionByName, [base, *passed]).groupBy("node").agg(F.max("base").alias("base")))
        left = cut(kept.groupBy("u", "v").agg(F.max("w").alias("w")))
        rounds.append((gone, ends))
        before, count = count, left.count()
        if count > before:
            more = 0
        elif count > STALLED * before:
            more = min(2 * more, MOST_EDGES) or 1
        else:
            more = MORE_EDGES
    if count > components.SMALL_GRAPH:
        core = _of(left, "u", "node").union(left.select("v")).distinct().select("node", F.lit(None).cast("long").alias("level"))
    else:
        core = _in_one_task(left, base, kind)
    core = cut(core)
    alone = nodes.join(core.select("node"), "node", "left_anti")
    for gone, _ in rounds:
        alone = alone.join(gone.select("node"), "node", "left_anti")
    known = [core, cut(alone.join(base, "node", "left").select("node", F.coalesce("base", F.lit(0).cast("long")).alias("level")))]
    for gone, ends in reversed(rounds):
        if len(known) >= SIDE_BY_SIDE:
            known = [cut(reduce(DataFrame.unionByName, known))]
        known.append(gone.filter("what = 'source'").select("node", F.col("base").alias("level")))
        for what in ("inner", "sink"):  # a sink may stand behind an inner node
            every = reduce(DataFrame.unionByName, known)
            above = ends.filter(F.col("what") == what).join(every.select(F.col("node").alias("u"), "level"), "u").groupBy("node").agg(
                F.max(F.col("level") + F.col("w")).alias("most"), F.bool_and(F.col("level").isNotNull()).alias("all"))
            known.append(cut(gone.filter(F.col("what") == what).join(above, "node").select(
                "node", F.when(F.col("all"), F.greatest("base", "most")).alias("level"))))
    return reduce(DataFrame.unionByName, known)
