"""Packing token ids into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back
from .tokens import encoder

#: Tokens packed together; a task goes on with a new group then.
GROUP_TOKENS = 2_000_000


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in ``k`` parts of nearly equal sums.

    Every item starts as a partial partition (itself and ``k - 1`` empty parts).
    The two partitions whose largest and smallest parts differ most are merged
    with opposing imbalances, largest part to smallest part, until one is left.
    A partition holds its parts in falling order less its smallest sum; parts
    that are empty and level with that are left out.
    """
    bags = [[i] for i in range(len(sizes))]
    one = lambda x: np.array([x], np.int64)
    state = {i: (one(s), one(i)) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        (_, i), (_, j) = heappop(heap), heappop(heap)
        (xs, xb), (ys, yb) = state.pop(i), state.pop(j)
        ordered = False
        if len(xs) < len(ys):
            xs, xb, ys, yb = ys, yb, xs, xb
        over = max(0, len(xs) + len(ys) - k)  # parts that must be shared: smallest with smallest kept last
        if len(ys) == 1:  # one item: into an empty part, or onto the smallest
            value, name = ys[0], yb[0]
            if over:
                value, name = value + xs[-1], xb[-1]
                bags[name].extend(bags[yb[0]])
                xs, xb = xs[:-1], xb[:-1]
            at = len(xs) - int(np.searchsorted(xs[::-1], value, "right"))
            sums = np.concatenate((xs[:at], [value], xs[at:]))
            names = np.concatenate((xb[:at], [name], xb[at:]))
            ordered = True
        elif over:
            # Of k places x fills the first, y the last, the other way round.
            ys, yb = ys[::-1], yb[::-1]
            sums, names = np.zeros(k, np.int64), np.full(k, -1)
            sums[: len(xs)], names[: len(xs)] = xs, xb
            at = k - len(ys)
            sums[at:] += ys
            for place in range(at, len(xs)):
                mine, theirs = names[place], yb[place - at]
                if len(bags[mine]) < len(bags[theirs]):
                    mine, theirs = theirs, mine
                bags[mine].extend(bags[theirs])
                names[place] = mine
            names[len(xs):] = yb[len(xs) - at:]
        else:
            sums, names = np.concatenate((xs, ys)), np.concatenate((xb, yb))
        if not ordered:
            order = np.argsort(-sums, kind="stable")
            sums, names = sums[order], names[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        state[fresh] = (sums, names)
        low = int(sums[-1]) if len(sums) == k else 0
        heappush(heap, (low - int(sums[0]), fresh))
        fresh += 1
    if not state:
        return []
    (_, names), = state.values()
    return [bags[n] for n in names]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes``, none above ``capacity``, in windows of at most ``capacity``.

    Starts from the fewest windows the total allows; as long as the fullest one
    is too full, their number rises by what would level it.
    """
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        parts = differenced(sizes, k)
        excess = max((sum(sizes[i] for i in p) for p in parts), default=0) - capacity
        if excess <= 0:
            return parts
        k += max(1, excess * k // capacity)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, by_words: bool = False,
         piece: int = 1024) -> DataFrame:
    """Pieces of all texts in sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A text is its ids and ``end_id``; null counts as empty.  Pieces of
    ``capacity`` are cut off and fill a sequence each; what remains of the
    documents, in pieces of at most ``piece``, is packed, ``GROUP_TOKENS`` at a
    time, in the order of the input.  (Smaller pieces level the windows better,
    and so leave less padding.)  So nothing is shuffled, memory is bounded by the group and the longest text,
    and at most about two sequences' worth of each group is padding.
    ``start`` is a piece's place in its document, ``offset`` its place in its
    sequence, ``ids`` little-endian unsigned 32-bit integers.  Repeated rows are
    packed as documents of their own; null doc_ids are carried; other columns are
    ignored; an empty table gives no rows.
    """
    def run(batches):
        encode, end = encoder(tokenizer, by_words), struct.pack("<I", end_id)
        part, number = TaskContext.get().partitionId() << 32, 0
        rest, held = [], 0  # (doc_id, start, ids, tokens of the document)

        def flush():
            nonlocal rest, held, number
            rows = []
            for window in windows_of([len(r[2]) // 4 for r in rest], capacity):
                at = 0
                for i in window:
                    doc_id, start, ids, n = rest[i]
                    rows.append((doc_id, start, len(ids) // 4, ids, n, part + number, at))
                    at += len(ids) // 4
                number += 1
            rest, held = [], 0
            return rows

        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                ids = encode(text.as_py() or b"") + end
                n, wide = len(ids) // 4, 4 * capacity
                whole = n // capacity
                for k in range(whole):
                    rows.append((doc_id, k * capacity, capacity, ids[k * wide: (k + 1) * wide], n, part + number, 0))
                    number += 1
                rest += [(doc_id, at, ids[4 * at: 4 * (at + piece)], n) for at in range(whole * capacity, n, piece)]
                held += n % capacity
                if held >= GROUP_TOKENS:
                    rows += flush()
                while len(rows) >= 4096:
                    yield _table(rows[:4096])
                    del rows[:4096]
            yield _table(rows)
        yield _table(flush())
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _table(rows) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 7
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_NAMES)


def pack_digests(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096,
                 by_words: bool = False) -> DataFrame:
    """``pack`` with a checksum in place of the ids."""
    return pack(docs, tokenizer, end_id, capacity, by_words).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
