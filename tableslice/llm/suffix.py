"""Exact substring deduplication: suffixes sorted by comparing prefix hashes.

Every string of ``length`` bytes has an anchor: of its 16-byte pieces the one
with the smallest hash, the leftmost of equals.  Equal strings have equal
anchors at equal places, so only strings with the same anchor are ever compared.
The strings of a text that share one anchor form a span, a run of some 70 bytes.

Every string has a route too: the places an anchor can have in a string are cut into
``ROUTES`` ranges, and strings of one range have the bytes around the anchor in
common that all of them hold, its context.

Documents are dealt into groups by id.  The steps, all in one Spark job:

1. Each group hashes its spans and sends, per distinct anchor and span, the two
   hashes, short ones of the contexts, and the smallest document to the bucket of
   the anchor.
2. A bucket says of each whether a smaller document has the same span (all its
   strings go), or on which routes another document has the anchor in the same
   context, as it must to share a string; most have neither.
3. Each group sends the bytes of those routes to the bucket of anchor and context.
   Where more than ``HOT`` spans have one context, each of their strings goes to
   the bucket of its own hash instead, once per group.
4. There the strings, suffixes cut at ``length``, are sorted by merging; equal
   neighbours are verified byte by byte, and each string learns whether a smaller
   document holds it.
5. Each group cuts out what is removed; it needs no hashes for that.

A span that a third of all documents hold comes once per group to a bucket, not
once per document, and so does a string of a hot context.  No string leaves its
group in steps 1, 2 and 5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_of

PIECE = 16
#: Bytes of text per group, and of text whose spans meet in a bucket.
GROUP_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20
#: Bytes hashed at once in a task, and strings sorted at once.
BLOCK, CHUNK = 1 << 17, 1 << 18
#: Ranges of an anchor's places in a string; more than so many spans of one context are dealt out string by string.
ROUTES, HOT = 4, 1 << 12

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A mark has a bit for each route, and another for each hot one; hot without the route stands for whole spans.
_NOTHING, _WHOLE = 0, 0xF0
_ENDS, _STRINGS = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


_powers = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.full(n, x, np.uint64)
            _powers[i][0] = 1
            np.cumprod(_powers[i], out=_powers[i])
    return _powers[0][:n], _powers[1][:n]


class Prefixes:
    """Polynomial hashes of all prefixes, modulo 2^64; equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.back = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, up to ``limit``, by bisection."""
        sa, sb, pa_, pb = self.sums[a], self.sums[b], self.back[a], self.back[b]

        def equal(i, n):
            return (self.sums[a[i] + n] - sa[i]) * pa_[i] == (self.sums[b[i] + n] - sb[i]) * pb[i]

        out = np.full(len(a), limit, np.int64)
        open_ = np.flatnonzero(~equal(slice(None), limit))
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), limit - 1, np.int64)
        for _ in range(int(limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = equal(open_, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        out[open_] = low
        return out


def cuts(length: int) -> list[int]:
    """Where the routes' ranges of places begin and end; a route may have none."""
    pieces = length - PIECE + 1
    return [r * pieces // ROUTES for r in range(ROUTES + 1)]


def spans(data: np.ndarray, borders: np.ndarray, length: int):
    """``anchor, span, sides, offset, first, last`` of every span.

    Those are hashes of the anchor, of the span and (12 bits per route, 0 where the
    span has no string of that route) of the anchor's context; the anchor's place
    in the span; the first and last string.  ``borders`` are the texts' starts and
    the end of all; strings lie in one text.
    """
    found, pieces, edges = [], length - PIECE + 1, cuts(length)
    place = np.arange(BLOCK + length, dtype=np.uint64)
    for begin in range(0, len(data), BLOCK):
        # Strings that start in this block; their bytes reach into the next.
        part = data[begin: begin + BLOCK + length - 1]
        n = len(part) - length + 1
        if n < 1:
            break
        x = np.empty(len(part) - 7, np.uint64)
        for k in range(8):
            x[k::8] = part[k: k + (len(part) - k) // 8 * 8].view("<u8")
        low = x[:-8] * _MUL
        low += x[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        low ^= low >> np.uint64(32)
        low *= np.uint64(0x94D049BB133111EB)
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= place[: len(low)]
        span = 1
        while 2 * span <= pieces:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < pieces:
            low = np.minimum(low[: len(low) - (pieces - span)], low[pieces - span:])
        # The texts' parts in this block, as ranges of their strings.
        texts = slice(np.searchsorted(borders, begin, "right") - 1, np.searchsorted(borders, begin + n))
        a = np.maximum(borders[:-1][texts] - begin, 0)
        b = np.minimum(borders[1:][texts] - begin - length + 1, n)
        a, b = a[b > a], b[b > a]
        if not len(a):
            continue
        new = np.append(True, low[1:n] != low[: n - 1])
        new[a] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        text = np.searchsorted(a, first, "right") - 1
        real = (text >= 0) & (first < b[text])
        first, last = first[real], np.minimum(last[real], b[text[real]] - 1)
        at = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        prefix = Prefixes(part)
        sides, most, least = np.zeros(len(at), np.uint64), at - first, at - last
        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                some = np.flatnonzero((most >= a) & (least < b))
                here = at[some]
                context = (_mix(prefix.of(here - a, here + (PIECE + pieces - b))) >> np.uint64(32)) % np.uint64(4095)
                sides[some] |= context + np.uint64(1) << np.uint64(12 * r)
        span = prefix.of(first, last + length)
        h = _mix(x[at] * _MUL ^ (x[at + 8] + np.uint64(0x632BE59BD9B4E019)))
        found.append((h, span, sides, at + begin, first + begin, last + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return *[none.astype(np.uint64)] * 3, none, none, none
    anchor, span, sides, at, first, last = (np.concatenate(c) for c in zip(*found))
    # A span cut by a block border stays two spans with the same anchor; each has strings of its own.
    span = _mix(span ^ _mix((at - first + (last - first) * length).astype(np.uint64)))
    return _mix(anchor), span, sides, at - first, first, last


def _tied(x: np.ndarray) -> np.ndarray:
    """Which of sorted values equal a neighbour."""
    same, out = x[1:] == x[:-1], np.zeros(len(x), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def in_order(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """Rows by id, then text (steps 3 and 5 must see one order); the texts; their starts and the end of all."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = [t or b"" for t in table.column("text").to_pylist()]
    return table, texts, np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


class Group:
    """The texts of one group and the distinct spans among them."""

    def __init__(self, table, length: int):
        table, texts, self.borders = in_order(table)
        known = table.column("doc_id").is_valid().to_numpy()
        self.ids = table.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        anchor, span, sides, self.offset, self.first, self.last = spans(self.data, self.borders, length)
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.first, self.borders)))
        if not known.all():
            keep = known[self.row]
            anchor, span, sides = anchor[keep], span[keep], sides[keep]
            self.offset, self.first, self.last, self.row = (
                x[keep] for x in (self.offset, self.first, self.last, self.row))
        # Most anchors are alone; only the others are sorted by more.  Rows are sorted
        # by id, so the first occurrence of a span is in its smallest document.
        order = np.argsort(anchor)
        ties = np.flatnonzero(_tied(anchor[order]))
        some = order[ties]
        order[ties] = some[np.lexsort((some, span[some], anchor[some]))]
        new = _heads(anchor[order], span[order])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]
        self.anchor, self.span, self.sides = anchor[self.head], span[self.head], sides[self.head]
        self.doc = self.ids[self.row[self.head]] if len(self.head) else np.zeros(0, np.int64)

    def buckets(self, n: int):
        """Entries are sorted by anchor; where each bucket, an equal share of all anchors, begins."""
        return _shares(self.anchor, n)


def _shares(keys: np.ndarray, n: int) -> np.ndarray:
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` high bytes of 64-bit numbers, all first bytes first: sorted ones compress well."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


_SENT = "bucket int, p int, n int, width int, least long, data binary"
_MARKS = "p int, bucket int, n int, marks binary"
_BYTES = "bucket int, p int, kind int, n int, a binary, b binary"
_TOLD = "p int, kind int, n int, a binary, b binary"


def _send(group: Group, p: int, n_buckets: int) -> list[tuple]:
    at, out = group.buckets(n_buckets), []
    sides = group.sides << np.uint64(16)
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        least = int(group.doc[s].min())
        docs = (group.doc[s] - least).view(np.uint64)
        width = max(1, -(-int(docs.max()).bit_length() // 8))
        data = (_planes(group.anchor[s], 7) + _planes(group.span[s], 6) + _planes(sides[s], 6)
                + _planes(docs << np.uint64(64 - 8 * width), width))
        out.append((int(b), p, int(at[b + 1] - at[b]), width, least, data))
    return out


def _judge(table, hot: int = HOT) -> list[bytes]:
    """Marks of all entries of a bucket, in the order each group sent them."""
    anchors, found, beside, docs, sizes = [], [], [], [], table.column("n").to_pylist()
    for n, width, least, data in zip(*(table.column(c).to_pylist() for c in ("n", "width", "least", "data"))):
        anchors.append(_unplanes(data[: 7 * n], n, 7))
        found.append(_unplanes(data[7 * n: 13 * n], n, 6))
        beside.append(_unplanes(data[13 * n: 19 * n], n, 6) >> np.uint64(16))
        docs.append((_unplanes(data[19 * n:], n, width) >> np.uint64(64 - 8 * width)).view(np.int64) + least)
    anchor, span, sides, doc = (np.concatenate(c) for c in (anchors, found, beside, docs))
    order = np.argsort(anchor)
    some = order[_tied(anchor[order])]
    some = some[np.lexsort((doc[some], span[some], anchor[some]))]
    heads = _heads(anchor[some], span[some])
    back = np.full(len(anchor), _NOTHING, np.uint8)
    back[some[~heads]] = _WHOLE
    # Spans of one anchor in different documents that agree on a context may share strings.
    some = some[heads]
    a, d = anchor[some], doc[some]
    for r in range(ROUTES):
        side = sides[some] >> np.uint64(12 * r) & np.uint64(4095)
        by = np.flatnonzero(side)
        by = by[np.lexsort((side[by], a[by]))]
        if not len(by):
            continue
        starts = np.flatnonzero(_heads(a[by], side[by]))
        size = np.diff(np.append(starts, len(by)))
        shared = np.minimum.reduceat(d[by], starts) < np.maximum.reduceat(d[by], starts)
        mark = np.where(shared, np.where(size > hot, 17 << r, 1 << r), 0).astype(np.uint8)
        back[some[by]] |= np.repeat(mark, size)
    ends = np.cumsum(sizes)
    return [back[e - n: e].tobytes() for e, n in zip(ends, sizes)]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...``, as many as ``count``, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs in a mask."""
    step = np.flatnonzero(np.concatenate((gone[:1], gone[1:] != gone[:-1], gone[-1:])))
    return step[::2], step[1::2] - 1


def _filled(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The mask of runs that do not overlap."""
    step = np.zeros(n + 1, np.int8)
    step[first] += 1
    step[last + 1] -= 1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def _edges_of(group: Group, mark: np.ndarray, p: int, n_buckets: int) -> list[tuple]:
    """What of a group goes to be sorted, by bucket, and what it knows of its removed strings itself."""
    length, limits = group.length, cuts(group.length)
    place = group.offset[group.head]
    least = place - (group.last - group.first)[group.head]
    routes = []
    singles = [(np.zeros(0, np.int64),) * 3]
    for r in range(ROUTES):
        entries = np.flatnonzero((mark != _WHOLE) & (mark & np.uint8(1 << r) != 0))
        high = np.minimum(place[entries], limits[r + 1] - 1)
        count = high - np.maximum(least[entries], limits[r]) + 1
        start = group.first[group.head[entries]] + place[entries] - high
        hot = mark[entries] & np.uint8(16 << r) != 0
        e, s, c = entries[hot], start[hot], count[hot]
        singles.append((np.repeat(e, c), _ranges(s, c), np.repeat(high[hot], c) - _ranges(np.zeros_like(c), c)))
        e = entries[~hot]
        side = group.sides[e] >> np.uint64(12 * r) & np.uint64(4095)
        key = _mix(group.anchor[e] ^ _mix(side + np.uint64(r << 12)))
        routes.append((key, group.doc[e], start[~hot], high[~hot], count[~hot]))

    # Strings of hot contexts: one per group and hash, the first of its smallest document.
    entry, start, high = (np.concatenate(c) for c in zip(*singles))
    known, twin, like = [np.zeros(0, np.int64)] * 3
    if len(entry):
        view = np.lib.stride_tricks.sliding_window_view(group.data, length)
        key = _mix(group.anchor[entry] ^ _mix(_string_hashes(view, start) + high.astype(np.uint64)))
        doc = group.doc[entry]
        order = np.lexsort((start, doc, key))
        head = _heads(key[order])
        one = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        other = ~head
        # Equal hashes of different bytes: those go to be sorted as well.
        for c in np.array_split(np.flatnonzero(other), len(order) // CHUNK + 1):
            other[c] = (view[start[order[c]]] == view[start[one[c]]]).all(axis=1)
        later = doc[order] > doc[one]
        known = start[order[other & later]]
        like, twin = start[one[other & ~later]], start[order[other & ~later]]
        sent = order[~other]
        routes.append((key[sent], doc[sent], start[sent], high[sent], np.ones(len(sent), np.int64)))

    later = group.ids[group.row] > group.doc[group.entry] if len(group.row) else np.zeros(0, bool)
    whole = later | (mark[group.entry] == _WHOLE)
    gone = _filled(len(group.data), group.first[whole], group.last[whole])
    # Spans that a document repeats lose the strings their first occurrence loses.
    again = ~whole & (mark[group.entry] != _NOTHING)
    again[group.head] = False
    again = np.flatnonzero(again)
    first, place = group.first[group.head[group.entry[again]]], group.first[again]
    count = (group.last - group.first + 1)[again]
    before = np.cumsum(count) - count
    runs = np.flatnonzero(_heads(first - before, place - before))
    count = np.add.reduceat(count, runs) if len(runs) else count
    gone[known] = True
    ends = np.stack(_runs(gone)).astype("<u4")
    alike = np.stack([np.concatenate(c) for c in (
        (like, first[runs]), (twin, place[runs]), (np.ones_like(twin), count))]).astype("<u4")
    out = [(p % n_buckets, p, _ENDS, len(twin), ends.tobytes(), alike.tobytes())]

    key, doc, start, high, count = (np.concatenate(c) for c in zip(*routes))
    order = np.argsort(key)
    key, doc, start, high, count = (x[order] for x in (key, doc, start, high, count))
    at = _shares(key, n_buckets)
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        numbers = b"".join(x[s].astype(t).tobytes() for x, t in zip((key, doc, start, high, count), _NUMBERS))
        text = group.data[_ranges(start[s], count[s] + length - 1)]
        out.append((int(b), p, _STRINGS, int(at[b + 1] - at[b]), numbers, text.tobytes()))
    return out


#: Of what is sent to be sorted: key, document, first string, the anchor's place in it, number of strings.
_NUMBERS = ("<u8", "<i8", "<u4", "u1", "u1")


def _string_hashes(view: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    up = powers(view.shape[1])[0]
    for at in range(0, len(start), 1 << 14):
        out[at: at + (1 << 14)] = (_LETTER[view[start[at: at + (1 << 14)]]] * up).sum(axis=1, dtype=np.uint64)
    return out


def merge_sorted(text: np.ndarray, prefix: Prefixes, suffix: np.ndarray, kind: np.ndarray, limit: int) -> np.ndarray:
    """Order of ``suffix`` (places in ``text``) by ``kind``, then by their first ``limit`` bytes.

    A bottom-up mergesort of all kinds at once.  A suffix finds its place in its
    sibling run by bisection; a comparison finds the common prefix by hashes and
    looks at the byte after it.
    """
    order = np.argsort(kind, kind="stable")
    k = kind[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(k)))
    start_of, size_of = np.repeat(begin, size), np.repeat(size, size)
    width = 1
    while width < (size.max() if len(size) else 0):
        active = np.flatnonzero(size_of > width)
        place = active - start_of[active]
        run = place // width
        sibling = run ^ 1
        low = np.minimum(sibling * width, size_of[active])
        high = np.minimum(low + width, size_of[active])
        base = low.copy()
        mine = suffix[order[active]]
        right = (run & 1).astype(bool)
        low, high = low.copy(), high.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) >> 1
            other = suffix[order[start_of[active[todo]] + mid]]
            own = mine[todo]
            n = prefix.common(own, other, limit)
            equal = n >= limit
            near = np.minimum(n, limit - 1)
            less = np.where(equal, False, text[other + near] < text[own + near])
            # Of equals those of the left run come first.
            before = less | (equal & right[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        pair = (run >> 1) * 2 * width
        moved = order.copy()
        moved[start_of[active] + pair + (place - run * width) + (low - base)] = order[active]
        order = moved
        width *= 2
    return order


def _held(key, doc, high, count, text, length: int) -> np.ndarray:
    """Which strings a smaller document holds, among entries sorted by key, whose bytes stand in ``text``."""
    span_start = np.append(0, np.cumsum(count + length - 1))[:-1]
    owner = np.repeat(np.arange(len(count)), count)
    step = _ranges(np.zeros_like(count), count)
    suffix = span_start[owner] + step
    # Equal strings have their equal anchors at equal places.
    heads = _heads(key)
    number, least = np.cumsum(heads) - 1, np.minimum.reduceat(high - count + 1, np.flatnonzero(heads))
    place = high - least[number]
    kind = (number * (int(place.max()) + 1) + place)[owner] - step
    doc = doc[owner]
    alone = np.bincount(kind, minlength=1)[kind] == 1
    held, some = np.zeros(len(kind), bool), np.flatnonzero(~alone)
    if not len(some):
        return held
    suffix, kind, doc = suffix[some], kind[some], doc[some]
    prefix = Prefixes(text)
    order = merge_sorted(text, prefix, suffix, kind, length)
    left, right = order[:-1], order[1:]
    same = kind[left] == kind[right]
    near = np.flatnonzero(same)
    a, b = suffix[left[near]], suffix[right[near]]
    same[near] = prefix.of(a, a + length) == prefix.of(b, b + length)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    claimed = np.flatnonzero(same)
    true = np.ones(len(claimed), bool)
    for at in range(0, len(claimed), 1 << 16):
        c = claimed[at: at + (1 << 16)]
        true[at: at + (1 << 16)] = (view[suffix[left[c]]] == view[suffix[right[c]]]).all(axis=1)
    if not true.all():  # different bytes with equal hashes: compare the bytes themselves
        keys = [view[suffix[i]].tobytes() for i in range(len(suffix))]
        order = np.array(sorted(range(len(suffix)), key=lambda i: (kind[i], keys[i])), np.int64)
        same = np.array([kind[i] == kind[j] and keys[i] == keys[j] for i, j in zip(order[:-1], order[1:])], bool)
    new = np.append(True, ~same)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    held[some[order]] = least[np.cumsum(new) - 1] < doc[order]
    return held


def _sort_edges(table, length: int, chunk: int = CHUNK) -> list[tuple[bytes, bytes]]:
    """For each group: first and last places of the runs of its strings that a smaller document holds."""
    sizes = table.column("n").to_pylist()
    parts, widths = [], [np.dtype(t).itemsize for t in _NUMBERS]
    for n, blob in zip(sizes, table.column("a").to_pylist()):
        at = np.append(0, np.cumsum(widths)) * n
        parts.append([np.frombuffer(blob, t, n, a) for t, a in zip(_NUMBERS, at.tolist())])
    key, doc, start, high, count = (np.concatenate(c) for c in zip(*parts))
    high, count, start = high.astype(np.int64), count.astype(np.int64), start.astype(np.int64)
    text = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8)
    begin = np.append(0, np.cumsum(count + length - 1))[:-1]
    order = np.argsort(key)
    # Keys are sorted some at a time, so that their bytes stay in reach; a key's entries stay together.
    heads = np.append(np.flatnonzero(_heads(key[order])), len(key))
    before = np.append(0, np.cumsum(count[order]))[heads]
    ends = heads[np.flatnonzero(np.diff(before // chunk, append=-1))]
    origin = np.append(0, np.cumsum(count))
    held = np.zeros(origin[-1], bool)
    for a, b in zip(np.append(0, ends[:-1]), ends):
        o = order[a:b]
        if len(o):
            part = text[_ranges(begin[o], count[o] + length - 1)]
            held[_ranges(origin[o], count[o])] = _held(key[o], doc[o], high[o], count[o], part, length)
    out, place, e = [], _ranges(start, count), 0
    for n in sizes:
        mine = slice(origin[e], origin[e + n])
        gone = np.sort(place[mine][held[mine]])
        new = np.append(True, np.diff(gone) > 1)[: len(gone)]
        out.append((gone[new].astype("<u4").tobytes(), gone[np.append(new[1:], True)[: len(gone)]].astype("<u4").tobytes()))
        e += n
    return out


def _removed(borders: np.ndarray, told: list[dict], length: int):
    """``row, start, end`` of the maximal removed runs, places in the row's text."""
    runs = [(np.frombuffer(r["a"], "<u4"), np.frombuffer(r["b"], "<u4")) for r in told if r["kind"] == _STRINGS]
    alike = []
    for r in told:
        if r["kind"] == _ENDS:
            runs.append(tuple(np.frombuffer(r["a"], "<u4").reshape(2, -1)))
            pairs = np.frombuffer(r["b"], "<u4").reshape(3, -1).astype(np.int64)
            # What the first part sets, the second may copy on.
            for part in (pairs[:, : r["n"]], pairs[:, r["n"]:]):
                alike += np.array_split(part, part[2].sum() // CHUNK + 1, axis=1)
    first, last = (np.concatenate(c).astype(np.int64) for c in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 2
    gone = _filled(int(borders[-1]), first, last)
    for like, twin, count in alike:
        gone[_ranges(twin, count)] = gone[_ranges(like, count)]
    start, end = _runs(gone)
    end = end + length
    row = np.searchsorted(borders, start, "right") - 1
    new = np.append(True, (start[1:] > end[:-1]) | (row[1:] != row[:-1]))[: len(start)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:] - 1, len(start) - 1)[: len(heads)]
    base = borders[row[heads]]
    return row[heads], start[heads] - base, end[tails] - base


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs`` (``doc_id, text``).

    A byte is removed if it lies in a string of ``length`` bytes (16 to 64 more
    than the anchor's, 50 by default) that also starts in a document with a
    smaller doc_id; strings are judged on the input.  ``spans`` are the maximal
    removed runs (``start, end`` in bytes), ``kept`` the bytes that stay.  A null
    text is empty.  Rows with one doc_id do not remove each other's bytes; rows
    without an id neither lose bytes nor cause it.  Other columns are ignored; no
    rows give none.
    """
    if not PIECE < length <= 64:
        raise ValueError(f"length must be above {PIECE} and at most 64")
    data = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    total = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups, n_buckets = groups_of(total, GROUP_BYTES, 12), groups_of(total, BUCKET_BYTES, 12)
    data = data.select(
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.length("text"))), F.lit(n_groups)).cast("int").alias("p"),
        "doc_id", "text")

    hot = HOT

    def send(key, table):
        return _rows(_send(Group(table, length), key[0].as_py(), n_buckets), _SENT)

    def judge(key, table):
        b = key[0].as_py()
        marks = zip(table.column("p").to_pylist(), table.column("n").to_pylist(), _judge(table, hot))
        return _rows([(p, b, n, m) for p, n, m in marks], _MARKS)

    def edges(key, texts, told):
        marks = b"".join(told.sort_by("bucket").column("marks").to_pylist())
        return _rows(_edges_of(Group(texts, length), np.frombuffer(marks, np.uint8), key[0].as_py(), n_buckets), _BYTES)

    def sort(key, table):
        kinds = np.array(table.column("kind").to_pylist())
        out = [(r["p"], _ENDS, r["n"], r["a"], r["b"]) for r in table.filter(pa.array(kinds == _ENDS)).to_pylist()]
        sent = table.filter(pa.array(kinds == _STRINGS))
        if sent.num_rows:
            runs = zip(sent.column("p").to_pylist(), _sort_edges(sent, length))
            out += [(p, _STRINGS, 0, first, last) for p, (first, last) in runs if first]
        return _rows(out, _TOLD)

    def finish(key, texts, told):
        if not texts.num_rows:
            return _rows([], _OUT)
        texts, data, borders = in_order(texts)
        runs: dict[int, list[dict]] = {}
        for row, s, e in zip(*(x.tolist() for x in _removed(borders, told.to_pylist(), length))):
            runs.setdefault(row, []).append({"start": s, "end": e})
        out = []
        for i, (doc_id, text) in enumerate(zip(texts.column("doc_id").to_pylist(), data)):
            gone = runs.get(i, [])
            edges_ = [0, *(x for g in gone for x in (g["start"], g["end"])), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges_[::2], edges_[1::2])) if gone else text
            out.append((doc_id, len(text), gone, kept))
        return _rows(out, _OUT)

    by_group = lambda: data.groupBy("p")
    sent = by_group().applyInArrow(send, _SENT)
    marked = sent.groupBy("bucket").applyInArrow(judge, _MARKS)
    moved = by_group().cogroup(marked.groupBy("p")).applyInArrow(edges, _BYTES)
    told = moved.groupBy("bucket").applyInArrow(sort, _TOLD)
    return by_group().cogroup(told.groupBy("p")).applyInArrow(finish, _OUT)


_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
    "array<struct<start:long,end:long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, _ARROW[kind]) for (name, kind), c in zip(fields, columns)})


def dedup_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """``deduplicate`` with counts and a checksum in place of spans and bytes."""
    runs = F.transform("spans", lambda s: s["end"] - s["start"])
    return deduplicate(docs, length).select(
        "doc_id", "n_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
