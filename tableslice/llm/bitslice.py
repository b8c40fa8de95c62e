"""Exact inner-product search over bit-sliced attributes."""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .shared import groups_of
from .vectors import matrix, usable

#: Bits kept of an attribute and of a query's component; the rest is left to the exact check.
ATTRIBUTE_BITS, QUERY_BITS = 6, 6
#: Vectors with a component of more bits are not sliced: sums of their products may leave 64-bit integers.
MAX_BITS = 27
#: Rows of one index block, queries that meet it together, queries added up at once.
BLOCK_ROWS, BLOCK_QUERIES, BATCH = 1 << 15, 1 << 14, 128


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, row 0 in the lowest bit."""
    pad = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def add(total: list[np.ndarray], addend: list[np.ndarray], at: int) -> None:
    """Add bit slices to bit slices in place, from slice ``at`` on; ``total`` is wide enough."""
    carry = None
    for k in range(at, len(total)):
        x = addend[k - at] if k - at < len(addend) else None
        t = total[k]
        if x is None and carry is None:
            return
        if x is None or carry is None:
            y = carry if x is None else x
            carry = t & y
            np.bitwise_xor(t, y, out=t)
            if x is None and not carry.any():
                return
        else:
            half = t ^ x
            np.bitwise_and(t, x, out=t)
            up = half & carry
            np.bitwise_or(up, t, out=up)
            np.bitwise_xor(half, carry, out=t)
            carry = up


class Index:
    """Bit slices of a block of integer vectors, one bitmap over its rows per attribute and bit."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, d = self.rows.shape
        low, high = (self.rows.min(), self.rows.max()) if n else (0, 0)
        self.shift = max(0, int(high - low).bit_length() - ATTRIBUTE_BITS)
        self.levels = (self.rows - low) >> self.shift
        self.bits = max(1, int(self.levels.max()).bit_length()) if n else 1
        self.slices = [[bitmap((self.levels[:, j] >> b & 1).astype(bool)) for b in range(self.bits)] for j in range(d)]
        rest = self.rows - low - (self.levels << self.shift) - ((1 << self.shift) - 1) / 2
        self.rest = float(np.sqrt((rest ** 2).sum(axis=1).max())) if n else 0.0
        self.centre = self.levels.mean(axis=0) if n else np.zeros(d)
        self.spread = float(np.sqrt(((self.levels - self.centre) ** 2).sum(axis=1).max())) if n else 0.0

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """``query, row, score`` positions of every query's ``k`` best rows, own ids left out, ties to smaller ids.

        Slices are added up to approximate scores.  From the highest slice down,
        counts of set bits find the score of the k-th row; rows that the rounding
        could have put below it are scored exactly and ranked.
        """
        n, d = self.rows.shape
        for begin in range(0, len(queries), BATCH):
            q, qid = queries[begin: begin + BATCH], query_ids[begin: begin + BATCH]
            size = np.abs(q)
            drop = max(0, int(size.max()).bit_length() - QUERY_BITS)
            whole = size >> drop
            q_bits = max(1, int(whole.max()).bit_length())
            width = self.bits + q_bits + int(d).bit_length()
            words = -(-n // 64)
            ones = ~np.uint64(0)
            negative = np.where(q < 0, ones, np.uint64(0))
            total = [np.zeros((len(q), words), np.uint64) for _ in range(width)]
            for a in range(q_bits):
                part = [np.zeros((len(q), words), np.uint64) for _ in range(self.bits + int(d).bit_length())]
                wanted = np.where(whole >> a & 1, ones, np.uint64(0))
                for j in range(d):
                    if wanted[:, j].any():
                        flip, mask = negative[:, j, None], wanted[:, j, None]
                        add(part, [(s ^ flip) & mask for s in self.slices[j]], 0)
                add(total, part, a)
            alive = np.ones((len(q), n), bool)
            own_lo, own_hi = np.searchsorted(self.ids, qid), np.searchsorted(self.ids, qid, "right")
            for i in np.flatnonzero(own_lo < own_hi):
                alive[i, own_lo[i]: own_hi[i]] = False
            alive = bitmap(alive)
            kth = self._kth(total, alive, k)
            # |score - what the slices say| is at most ``error``, for every row of the block.
            tail = q - np.sign(q) * (whole << drop)
            error = (
                np.sqrt((q.astype(float) ** 2).sum(axis=1)) * self.rest
                + np.sqrt((tail.astype(float) ** 2).sum(axis=1)) * self.spread * (1 << self.shift)
            ) / (1 << (self.shift + drop))
            least = np.maximum(0, kth - np.ceil(2 * error + 2).astype(np.int64))
            near = self._at_least(total, least) & alive
            for i in range(len(q)):
                rows = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little")[:n])
                if not len(rows):
                    continue
                scores = self.rows[rows] @ q[i]
                best = np.lexsort((self.ids[rows], -scores))[:k]
                yield qid[i], self.ids[rows[best]], scores[best]

    @staticmethod
    def _kth(total, alive, k: int) -> np.ndarray:
        """Approximate score of the k-th best living row of each query; 0 if there are fewer."""
        level, found = alive.copy(), np.zeros(len(alive), np.int64)
        value = np.zeros(len(alive), np.int64)
        for b in range(len(total) - 1, -1, -1):
            high = level & total[b]
            n = np.bitwise_count(high).sum(axis=1, dtype=np.int64)
            enough = found + n >= k
            value += np.where(enough, 1 << b, 0)
            found += np.where(enough, 0, n)
            level = np.where(enough[:, None], high, level & ~total[b])
        return np.where(np.bitwise_count(alive).sum(axis=1, dtype=np.int64) < k, 0, value)

    @staticmethod
    def _at_least(total, least: np.ndarray) -> np.ndarray:
        above = np.zeros_like(total[0])
        level = np.full_like(total[0], ~np.uint64(0))
        for b in range(len(total) - 1, -1, -1):
            bit = (least >> b & 1).astype(bool)[:, None]
            above |= np.where(bit, np.uint64(0), level & total[b])
            level &= np.where(bit, total[b], ~total[b])
        return above | level


def exact_top(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, vec_id: str = "vec_id",
              embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of highest integer inner product.

    A component x is floor(``scale`` * x).  Queries are the rows for which the
    column ``is_query`` holds, candidates all rows with another id.  Vectors
    that are null, empty, or hold null or non-finite components take no part;
    vectors meet only vectors of their length.  The few with integers beyond
    ``MAX_BITS`` bits are compared apart, in whole numbers of any length; only a
    pair whose score does not fit 64 bits has no row.
    Ties go to the smaller id; a null id is no query and no candidate.  Repeated
    rows are candidates each; of repeated query rows one counts.  Fewer than
    ``k`` candidates give fewer rows, no rows give none.

    Rows are dealt into blocks of ``BLOCK_ROWS`` by a hash, queries into blocks
    of ``BLOCK_QUERIES``; each pair of blocks is one group, from which every
    query's ``k`` best come back.  A block pair holds a bounded number of rows
    and no product of rows is ever written.
    """
    def whole(y):  # beyond 2 ** 52 a double is whole anyway
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    every_row = (
        vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"),
                       is_query.alias("q"))
        .filter(F.col("id").isNotNull() & usable(F.col("x")))
        .select("id", F.transform("x", lambda x: whole(x * scale)).alias("x"),
                F.size("x").alias("d"), F.coalesce("q", F.lit(False)).alias("q"))
    )
    small = F.array_max(F.transform("x", lambda x: F.abs(x))) < float(1 << MAX_BITS)
    data = cut(every_row.filter(small).withColumn("x", F.col("x").cast("array<int>")))
    wide = cut(every_row.filter(~small))
    n = data.agg(F.count(F.lit(1)).alias("rows"), F.count_if("q").alias("queries")).first()
    row_blocks = groups_of(n["rows"], BLOCK_ROWS, 12)
    query_blocks = groups_of(n["queries"], BLOCK_QUERIES)
    # Both sides of a key must be of one type: a long is dealt elsewhere than the same int.
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = data.select("id", "x", "d", deal(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    queries = data.filter("q").select("id", "x", "d", deal(query_blocks).alias("qb"), every(row_blocks).alias("rb"))

    def search(left, right):
        out = []
        if left.num_rows and right.num_rows:
            index = Index(left.column("id").to_numpy(), matrix(left.column("x")).astype(np.int64))
            ids, first = np.unique(right.column("id").to_numpy(), return_index=True)
            wanted = matrix(right.column("x")).astype(np.int64)[first]
            for q, rows, scores in index.top(ids, wanted, k):
                out.append((np.full(len(rows), q), rows, scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ["d", "rb", "qb"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        search, "query_id long, vec_id long, score long")
    if not wide.isEmpty():
        plain = data.withColumn("x", F.col("x").cast("array<double>"))
        both = plain.unionByName(wide)
        found = found.unionByName(_compared(wide, both.filter("q"), k)).unionByName(_compared(plain, wide.filter("q"), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _compared(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``rows`` for each of ``queries``, compared one by one; ``x`` holds whole numbers as doubles."""
    n = queries.count()
    blocks = groups_of(n, 512)
    parts = groups_of(rows.count(), 4096)
    deal = lambda b: F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    left = rows.select("id", "x", "d", deal(parts).alias("rb"), every(blocks).alias("qb"))
    right = queries.select("id", "x", "d", deal(blocks).alias("qb"), every(parts).alias("rb"))

    def search(a, b):
        out = []
        known = [(i, [int(v) for v in x]) for i, x in zip(a.column("id").to_pylist(), a.column("x").to_pylist())]
        wanted = dict(zip(b.column("id").to_pylist(), b.column("x").to_pylist()))
        for q, x in wanted.items():
            x = [int(v) for v in x]
            scored = ((-sum(map(operator.mul, x, y)), i) for i, y in known if i != q)
            out += [(q, i, -s) for s, i in heapq.nsmallest(k, (p for p in scored if -(1 << 63) < p[0] <= (1 << 63)))]
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["d", "rb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
