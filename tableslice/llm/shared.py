"""What several operators here need: spread-out tables, word rules, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def give_back() -> None:
    """Hand memory that a task has freed back to the system; a worker lives on and is counted with its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def groups_of(total: int, target: int, least: int = 1) -> int:
    """How many groups hold ``total`` if one should hold about ``target``."""
    return max(least, -(-int(total) // target))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position for each of ``n`` positions linked by ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of undirected ``edges``; root is its component's smallest node.

    Rounds of two steps: every node ties its larger neighbours to the smallest
    node it sees, then its smaller neighbours and itself.  The rounds grow with
    the logarithm of the nodes, not with the length of a chain.  Minima are
    combined before the shuffle, so a node that a third of all edges touch is
    one row after it; each round is written to the shared folder.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    links = cut(links)
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        wide = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v").distinct()
        )
        down = wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        links = cut(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        )
        now = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if before == now:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
