"""Near duplicates of vectors: a neighbour graph refined by NN-descent, its strong edges kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .shared import components, groups_of, roots
from .vectors import matrix, usable

#: Length of a neighbour list, and of the reverse list beside it in a round.
K = 10
#: Orders the first graph is read from, sign bits of each, neighbours looked at in an order.
ORDERS, SIGNS, REACH = 4, 12, 4
#: Rounds at most; they end when fewer than this share of all list places changed.
ROUNDS, STILL = 4, 0.005
#: Vectors with full and with other lists that an audit compares with every other, and the recall it asks of a class.
AUDIT, RECALL = 256, 0.99
#: Turns with longer and longer lists; a class that no audit has passed by then is compared exactly.
TURNS = 3
#: Rows of one side of an exact comparison within a component.
BLOCK = 2048

_EDGES = "src long, dst long, sim double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(src, dst, sim) -> dict:
    return {"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float64())}


def first_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """Candidate edges between neighbours in a few random orders of the vectors of each class.

    An order sorts by the signs of random projections, then by one projection.
    The sort is by range, so a dense spot is split over partitions like any
    other; neighbours on two sides of a border are left to the rounds.
    """
    def place(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                x = _unit(matrix(part.column(2)))
                planes = np.random.default_rng(seed + int(n)).normal(size=(n, ORDERS * (SIGNS + 1)))
                p = (x @ planes).reshape(len(x), ORDERS, SIGNS + 1)
                signs = ((p[:, :, 1:] > 0) << np.arange(SIGNS)).sum(axis=2)
                for r in range(ORDERS):
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(x), r, np.int32)), pa.array(signs[:, r]),
                         pa.array(p[:, r, 0])], names=["id", "kind", "x", "r", "sign", "along"])

    def compare(batches):
        kind, order, ids, x = [np.zeros(0, np.int64)] * 3 + [None]
        for batch in batches:
            kind = np.concatenate((kind, batch.column(1).to_numpy()))
            order = np.concatenate((order, batch.column(3).to_numpy()))
            ids = np.concatenate((ids, batch.column(0).to_numpy()))
            fresh = list(_rows(batch.column(2)))
            x = fresh if x is None else x + fresh
            for step in range(1, REACH + 1):
                same = np.flatnonzero((kind[step:] == kind[:-step]) & (order[step:] == order[:-step]))
                for at in range(0, len(same), 1 << 14):
                    s = same[at: at + (1 << 14)]
                    a, b = _unit(np.stack([x[i] for i in s])), _unit(np.stack([x[i + step] for i in s]))
                    sims = (a * b).sum(axis=1)
                    yield pa.RecordBatch.from_pydict(_edges(ids[s], ids[s + step], sims))
            kind, order, ids, x = kind[-REACH:], order[-REACH:], ids[-REACH:], x[-REACH:]

    placed = nodes.select("id", "kind", "x").mapInArrow(
        place, "id long, kind long, x array<double>, r int, sign long, along double")
    keys = ["kind", "r", "sign", "along", "id"]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(compare, _EDGES)


def _rows(column):
    """Vectors of a column whose lengths may differ between classes."""
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar distinct neighbours of every node."""
    once = edges.filter("src <> dst").groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "fresh"))


def refine(graph: DataFrame, nodes: DataFrame, k: int, groups: int) -> DataFrame:
    """One round: neighbours of a node, its own and those that name it, are compared with each other.

    Pairs in which one is new to the list are compared; those that beat the last
    place of either list come back.  Reverse lists are cut to ``k`` by a hash, as
    a search heuristic; no edge is removed from the graph for it.
    """
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fresh")
    spread = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("fresh"), F.xxhash64("src", "dst")))
    back = back.withColumn("n", spread).filter(F.col("n") <= k).drop("n")
    around = (
        graph.select("src", "dst", "fresh").unionByName(back)
        .groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
    )
    last = graph.groupBy("src").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n")).select(
        F.col("src").alias("id"), F.when(F.col("n") >= k, F.col("last")).otherwise(-2.0).alias("last"))
    known = nodes.join(last, "id", "left").select(
        F.col("id").alias("dst"), "x", F.coalesce("last", F.lit(-2.0)).alias("last"))
    lists = around.join(known, "dst").withColumn("g", F.pmod(F.xxhash64("src"), F.lit(groups)))

    def join(table):
        table = table.sort_by("src")
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        fresh, last = table.column("fresh").to_numpy(), table.column("last").to_numpy()
        x = _rows(table.column("x").combine_chunks())
        out = []
        borders = np.flatnonzero(np.diff(src)) + 1
        for a, b in zip(np.append(0, borders), np.append(borders, len(src))):
            if b - a < 2 or not fresh[a:b].any():
                continue
            u = _unit(np.stack(x[a:b]))
            sims = u @ u.T
            i, j = np.triu_indices(b - a, 1)
            s, d, f = sims[i, j], dst[a:b], fresh[a:b]
            good = ((f[i] | f[j]) > 0) & (s > np.minimum(last[a:b][i], last[a:b][j]))
            out.append((d[i[good]], d[j[good]], s[good]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(_edges(*columns))

    found = lists.groupBy("g").applyInArrow(join, "src long, dst long, sim double")
    old = graph.withColumn("fresh", F.lit(0))
    return _best(old.unionByName(_both_ways(found.withColumn("fresh", F.lit(1)))), k)


def neighbour_graph(nodes: DataFrame, k: int, seed: int, graph: DataFrame | None = None) -> DataFrame:
    """``src, dst, sim``: about the ``k`` nearest vectors of every vector among those of its class."""
    n = nodes.count()
    groups = groups_of(n, 1000, 12)
    start = _both_ways(first_graph(nodes, seed).withColumn("fresh", F.lit(1)))
    if graph is not None:
        start = start.unionByName(graph.withColumn("fresh", F.lit(1)))
    graph = cut(_best(start, k))
    for _ in range(ROUNDS):
        graph = cut(refine(graph, nodes, k, groups))
        if graph.filter("fresh = 1").count() <= STILL * n * k:
            break
    return graph.drop("fresh")


def _in_blocks(left: DataFrame, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """``id, n, to``: rows of ``left`` and how many copies in ``right`` of their ``key`` are at least ``threshold`` similar.

    Both sides (``key, id, x, copies``) are dealt into blocks of about ``BLOCK``
    rows; each pair of blocks is one group.  It gives a count for each row,
    itself left out, and the links of a forest that spans what is linked in it
    (``to``, with ``n`` 0), but no pairs.
    """
    def blocked(df):
        size = df.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
        return df, size

    left, l_size = blocked(left)
    right, r_size = blocked(right)
    sizes = l_size.withColumnRenamed("blocks", "lb").join(r_size.withColumnRenamed("blocks", "rb"), key)
    # Both sides of a key must be of one type: a long is dealt elsewhere than the same int.
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, key).select(key, "id", "x", part("lb").alias("i"), every("rb").alias("j"))
    b = right.join(sizes, key).select(key, "id", "x", "copies", part("rb").alias("j"), every("lb").alias("i"))

    def compare(x, y):
        ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
        if not len(ids) or not len(others):
            return pa.table({n: pa.array([], pa.int64()) for n in ("id", "n", "to")})
        u, v = _unit(matrix(x.column("x"))), _unit(matrix(y.column("x")))
        copies, n = y.column("copies").to_numpy(), np.zeros(len(ids), np.int64)
        known, place = np.unique(np.concatenate((ids, others)), return_inverse=True)
        label = np.arange(len(known))
        for at in range(0, len(ids), 256):
            near = (u[at: at + 256] @ v.T >= threshold) & (ids[at: at + 256, None] != others[None, :])
            n[at: at + 256] = near @ copies
            i, j = np.nonzero(near)
            label = roots(len(known), label[place[at + i]], label[place[len(ids) + j]])[label]
        tied = np.flatnonzero(label != np.arange(len(known)))
        none = pa.nulls(len(ids), pa.int64())
        return pa.table({
            "id": np.concatenate((ids, known[tied])), "n": np.concatenate((n, np.zeros(len(tied), np.int64))),
            "to": pa.concat_arrays([none, pa.array(known[label[tied]], pa.int64())])})

    keys = [key, "i", "j"]
    b = b.toDF(*b.columns)  # columns of its own, also where both sides come from one table
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(compare, "id long, n long, to long")


def _counts_in_blocks(left: DataFrame, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """``id, n`` of ``_in_blocks``, added up."""
    return _in_blocks(left, right, key, threshold).filter("to IS NULL").groupBy("id").agg(F.sum("n").alias("n"))


def linked(nodes: DataFrame, graph: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links at ``threshold`` or above: ``id, n, full`` (how many copies it links to) and the links, ``src, dst``; ``id, root``.

    A list whose ``k`` places all hold links is full: there may be more.  It
    is enlarged to all vectors of the component that the links span, compared
    exactly in blocks and counted, not listed.
    """
    strong = cut(graph.filter(F.col("sim") >= threshold).select("src", "dst"))
    full = strong.groupBy("src").count().filter(F.col("count") >= k).select(F.col("src").alias("id"))
    rooted = cut(components(strong, "src", "dst").withColumnRenamed("node", "id"))
    either = strong.union(strong.select("dst", "src")).distinct()
    listed = either.join(nodes.select(F.col("id").alias("dst"), "copies"), "dst").groupBy(
        F.col("src").alias("id")).agg(F.sum("copies").alias("n"))
    wide = cut(rooted.join(full, "id"))
    members = rooted.join(wide.select("root").distinct(), "root").join(nodes, "id").select("root", "id", "x", "copies")
    counted = _counts_in_blocks(
        wide.join(nodes, "id").select("root", "id", "x"), members, "root", threshold)
    n = listed.join(counted.withColumnRenamed("n", "all"), "id", "left").select(
        "id", F.greatest("n", F.coalesce("all", F.lit(0))).alias("n"), F.col("all").isNotNull().alias("full"))
    return cut(n), strong, rooted


def _shares(nodes: DataFrame, counts: DataFrame, threshold: float, size: int) -> DataFrame:
    """``kind, share`` of the links that ``counts`` knows of drawn vectors that have any.

    ``size`` vectors with full lists and as many others are drawn by a hash and
    compared with all of their class.  Each of them counts alike, so that a few
    with many links cannot speak for the rest.
    """
    if "full" not in counts.columns:
        counts = counts.withColumn("full", F.lit(False))
    told = nodes.join(counts, "id", "left").select(
        "id", "kind", "x", F.coalesce("n", F.lit(0)).alias("found"), F.coalesce("full", F.lit(False)).alias("full"))
    by_hash = F.xxhash64("id", F.lit("audit"))
    drawn = cut(told.filter("full").orderBy(by_hash).limit(size).unionByName(
        told.filter("NOT full").orderBy(by_hash).limit(size)))
    true = _counts_in_blocks(drawn.select("kind", "id", "x"), nodes.select("kind", "id", "x", "copies"), "kind", threshold)
    return drawn.join(true, "id").filter("n > 0").select("kind", (F.least("n", "found") / F.col("n")).alias("share"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, size: int = AUDIT) -> float:
    """Average share of a drawn vector's links that ``counts`` knows; 1 where none has any."""
    return _shares(nodes, counts, threshold, size).agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def short_classes(nodes: DataFrame, counts: DataFrame, threshold: float, recall: float, size: int = AUDIT) -> DataFrame:
    """``kind`` of the classes of whose drawn vectors ``counts`` knows less than ``recall`` of the links."""
    shares = _shares(nodes, counts, threshold, size)
    return cut(shares.groupBy("kind").agg(F.avg("share").alias("recall")).filter(F.col("recall") < recall).select("kind"))


def finished(nodes: DataFrame, counts: DataFrame, strong: DataFrame, short: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Counts and components once the classes ``short`` (``kind``) have been compared exactly, block by block."""
    rows = nodes.join(short, "kind", "left_semi").select("kind", "id", "x", "copies")
    exact = cut(_in_blocks(rows.drop("copies"), rows, "kind", threshold))
    n = exact.filter("to IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.select("id", "n").join(n.select("id"), "id", "left_anti").unionByName(n)
    links = strong.unionAll(exact.filter("to IS NOT NULL").select(F.col("id").alias("src"), F.col("to").alias("dst")))
    return cut(counts), cut(components(links, "src", "dst").withColumnRenamed("node", "id"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = K, seed: int = 11,
                    recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row (``vec_id, embedding, label``).

    Vectors of one label and length link when their cosine, in doubles, is at
    least ``threshold``.  ``n_links`` counts the rows linked directly, among them
    exact copies; ``component_id`` is the smallest vec_id reachable, ``kept``
    says whether that is the row's own.  Vectors that are null, empty, all zero,
    or hold null or non-finite components, and rows without a label, link with
    nothing.  A null vec_id is never a component's smallest while others are
    there.  Exact copies are one node, so they are never paired with each other;
    repeated rows count as copies.  Other columns are ignored; no rows give none.

    The graph is approximate: an audit compares a sample with all vectors.  While
    it knows less than ``recall`` of their links in some class, twice as long
    lists are refined from other orders; classes still below that after ``TURNS``
    turns are compared exactly, all vectors with all, in blocks.
    """
    x = F.col("embedding").cast("array<double>")
    taking = usable(F.col("embedding").cast("array<double>")) & F.exists(x, lambda v: v != 0) & F.col("label").isNotNull()
    rows = cut(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.when(taking, F.transform(x, lambda v: v + 0.0)).alias("x")))
    classes = cut(
        rows.filter("x IS NOT NULL").groupBy("label", "x").agg(
            F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    ).withColumn("id", F.monotonically_increasing_id()).withColumn("kind", F.xxhash64("label", F.size("x")))
    nodes = cut(classes)
    graph = None
    for turn in range(TURNS):
        graph = neighbour_graph(nodes, k << turn, seed + turn, graph)
        counts, strong, tied = linked(nodes, graph, k << turn, threshold)
        short = short_classes(nodes, counts, threshold, recall)
        if short.isEmpty():
            break
    else:
        counts, tied = finished(nodes, counts, strong, short, threshold)
    rooted = nodes.join(tied, "id", "left").withColumn("root", F.coalesce("root", "id")).select(
        "id", "label", "x", "first", "copies", "root")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").join(counts, "id", "left").select(
        "label", "x", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_x = rows.filter("x IS NOT NULL").join(named, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("x IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return with_x.unionAll(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
