"""Near duplicates by 64-bit fingerprints, joined by walking a binary trie against itself."""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .shared import components, give_back, roots

BITS = 64
#: Pairs of trie nodes handled at once in a task, and pairs of leaves compared directly.
CHUNK = 1 << 19
LEAF = 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bitwise majority over the hashes of all word shingles; 0 without words."""
    found = text.lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    if not found:
        return 0
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        whole = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
        stops = (ends[words - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], seed) for s, e in zip(starts, stops)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at: at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` per row; ``fp`` is the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", words, seed) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, spent: int, budget: int):
    """Positions ``i, j`` of fingerprints at most ``budget`` bits apart, in chunks.

    ``left`` and ``right`` are sorted and each share their first ``depth`` bits,
    which differ in ``spent`` places; ``right`` None joins ``left`` with itself.
    A node is a range of a sorted array.  A pair of nodes is opened bit by bit;
    a child pair with differing bits costs one of the budget and is dropped
    once that is exceeded.  Chunks are taken depth first, so memory holds a few
    chunks per level whatever the arrays' lengths.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right) or spent > budget:
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(left)), one(0), one(len(right)), one(spent))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        small = (ah - al) * (bh - bl) <= LEAF
        if d == BITS:
            small[:] = True
        if small.any():
            yield from _leaves(left, right, own, al[small], ah[small], bl[small], bh[small], budget)
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        low = np.uint64(BITS - 1 - d)
        bit = np.uint64(1) << low
        head = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        am = np.clip(np.searchsorted(left, (left[al] & head) | bit), al, ah)
        bm = np.clip(np.searchsorted(right, (right[bl] & head) | bit), bl, bh)
        same = own & (al == bl) & (ah == bh)
        parts = [
            (al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
            tuple(x[~same] for x in (am, ah, bl, bm, err + 1)),
        ]
        nxt = []
        for part in parts:
            keep = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= budget)
            nxt.append(tuple(x[keep] for x in part))
        whole = [np.concatenate(x) for x in zip(*nxt)]
        for at in range(0, len(whole[0]), CHUNK):
            stack.append((d + 1, *(x[at: at + CHUNK] for x in whole)))


def _leaves(left, right, own, al, ah, bl, bh, budget):
    na, nb = ah - al, bh - bl
    for at in range(0, len(al), CHUNK):
        s = slice(at, at + CHUNK)
        n = na[s] * nb[s]
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = al[s][which] + place // nb[s][which]
        j = bl[s][which] + place % nb[s][which]
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if own:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def fingerprint_links(distinct: DataFrame, budget: int = 3, node_rows: int = 1 << 20,
                      least_depth: int = 4) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``budget`` bits.

    The trie is opened to a depth at which a node holds about ``node_rows``
    fingerprints; every pair of nodes there whose prefixes are within the budget
    is one group.  A fingerprint goes to as many groups as there are prefixes
    around its own: 15 at depth 4, 42 at depth 6.  From each group come the links
    of a spanning forest, so that a dense group sends no more rows than it has
    fingerprints.
    """
    n = distinct.count()
    depth = max(least_depth, int(log2(max(1, n / node_rows))) + 1)
    masks = [sum(1 << x for x in c) for k in range(budget + 1) for c in combinations(range(depth), k)]
    node = F.shiftrightunsigned("fp", BITS - depth)
    spread = distinct.select("fp", node.alias("node"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    spread = spread.select(
        "fp",
        F.least("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("lo"),
        F.greatest("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("hi"),
    )

    def join(key, table):
        lo, hi = key[0].as_py(), key[1].as_py()
        fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
        cut_at = int(np.searchsorted(fps, np.uint64((lo + 1) << (BITS - depth)))) if lo != hi else len(fps)
        left, right = fps[:cut_at], (fps[cut_at:] if lo != hi else None)
        label = np.arange(len(fps))
        for i, j in trie_links(left, right, depth, (lo ^ hi).bit_count(), budget):
            more = roots(len(fps), label[i], label[j + (cut_at if lo != hi else 0)])
            label = more[label]
        tied = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": fps[tied].view(np.int64), "b": fps[label[tied]].view(np.int64)})

    return spread.groupBy("lo", "hi").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``).

    Documents with one fingerprint are one node; fingerprints at most ``budget``
    bits apart are linked, transitively.  ``component_id`` is the smallest
    doc_id reachable.  A null, empty or blank text has fingerprint 0 and links
    like any other.  Repeated rows give repeated results, a null doc_id is
    never a component's smallest (a component of nulls only has null), other
    columns are ignored, and an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, words, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    comps = cut(components(fingerprint_links(distinct, budget)))
    tied = distinct.join(comps, distinct["fp"] == comps["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    first = tied.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = tied.join(first, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Of several rows with that id one stays, the first by its columns that have an
    order; rows without an id all stay.  Columns are those of ``docs``.
    """
    groups = near_duplicates(docs, words, budget, seed)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    plain = [f"`{f.name}`" for f in docs.schema if f.name in rest and not _has_map(f.dataType)]
    once = (
        docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi").groupBy("doc_id")
        .agg(F.min_by(F.struct(*[f"`{c}`" for c in rest]), F.struct(*plain)).alias("__row"))
    )
    once = once.select("doc_id", *[F.col(f"__row.`{c}`") for c in rest]).select(
        *[f"`{c}`" for c in docs.columns]
    )
    return once.unionAll(docs.filter("doc_id IS NULL"))


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
