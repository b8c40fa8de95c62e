import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableslice.llm import suffix


def slow(rows, length=50):
    """Digest columns per row from a table of all strings."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - length + 1):
                s = data[i: i + length]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        if doc_id is not None:
            for i in range(len(data) - length + 1):
                if first[data[i: i + length]] < doc_id:
                    gone[i: i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit("x")).withColumn("spans", F.lit(1))
    got = sorted((tuple(r) for r in suffix.dedup_digests(docs).collect()), key=lambda r: (r[0] is None, r))
    assert got == slow(rows)


def test_prefix_hashes_find_common_prefixes():
    data = np.frombuffer(b"abracadabra abracadabra!" * 3, np.uint8)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, len(data) - 20, (2, 500))
    want = [next((k for k in range(20) if data[i + k] != data[j + k]), 20) for i, j in zip(a, b)]
    assert suffix.Prefixes(data).common(a, b, 20).tolist() == want


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    places, kind = rng.permutation(550), rng.integers(0, 7, 550)
    order = suffix.merge_sorted(text, suffix.Prefixes(text), places, kind, 50)
    keys = [(int(kind[i]), text[places[i]: places[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_sample_equals_brute_force(spark, spread):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in suffix.dedup_digests(docs).collect())
    assert got == slow(rows) and any(r[2] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_edges_and_few_letters(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(200), 60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            parts.append(p[a: a + rng.randint(1, 200)])
        rows.append((i, "".join(parts)))
    same(spark, rows)


def test_odd_rows(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    same(spark, [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 120), (6, "y" + "x" * 60 + "z"),
                 (7, long), (7, long), (8, long[:50]), (9, long[:49]), (None, long), (None, long), (-3, long[100:151]),
                 (10, "é" * 25), (11, "a" + "é" * 25), (12, "x" * 5_000)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.dedup_digests(empty).collect() == []


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    borders = np.append(0, np.cumsum([len(t) for _, t in rows]))
    strings = lambda s: {(int(a), int(x)) for a, f, l in zip(s[0], s[4], s[5]) for x in range(f, l + 1)}
    one = strings(suffix.spans(data, borders, 50))
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    assert strings(suffix.spans(data, borders, 50)) == one


@pytest.mark.parametrize("hot, length", [(2, 50), (2, 17), (1 << 12, 64), (2, 64)])
def test_strings_of_crowded_anchors_and_other_lengths(spark, monkeypatch, hot, length):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(hot + length)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    head, line = letters(41), letters(70)
    rows = [(i, letters(rng.randint(0, 30)) + rng.choice([head, line]) + rng.choice("xyz") + letters(rng.randint(0, 40)))
            for i in range(80)]
    # Texts that repeat the fragment themselves, ids that come twice or not at all.
    rows += [(i, (head + letters(4) + line[:60] + letters(2) + head) * 2) for i in (3, 200, 201, 201, 202)]
    rows += [(202, rows[-1][1]), (None, head + line), (-1, line[5:] + head), (5, "x" * 900), (6, "ab" * 400), (7, "x" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix.dedup_digests(docs, length).collect()), key=lambda r: (r[0] is None, r))
    assert got == slow(rows, length)


def shares(n, hot, buckets=12):
    """Strings to be sorted, by bucket, of ``n`` texts in three groups that hold one fragment, and the keys of them."""
    rng = random.Random(n)
    letters = lambda k: "".join(rng.choice("abcdefghijkl ") for _ in range(k)).encode()
    fragment, groups, sent = letters(48), [], []
    for p in range(3):
        table = pa.table({"doc_id": list(range(p, n, 3)), "text": [letters(60) + fragment + letters(60) for _ in range(p, n, 3)]})
        groups.append(suffix.Group(table, 50))
        sent += suffix._send(groups[-1], p, buckets)
    marks = {p: np.zeros(len(g.anchor), np.uint8) for p, g in enumerate(groups)}
    for b in range(buckets):
        rows = [r for r in sent if r[0] == b]
        for r, m in zip(rows, suffix._judge(suffix._rows(rows, suffix._SENT), hot) if rows else []):
            at = groups[r[1]].buckets(buckets)
            marks[r[1]][at[b]: at[b + 1]] = np.frombuffer(m, np.uint8)
    count, keys = np.zeros(buckets, int), []
    for p, g in enumerate(groups):
        for b, _, kind, k, numbers, _ in suffix._edges_of(g, marks[p], p, buckets):
            if kind == suffix._STRINGS:
                count[b] += np.frombuffer(numbers, "u1")[21 * k:].sum()
                keys.append(np.frombuffer(numbers, "<u8", k))
    return count, np.unique(np.concatenate(keys), return_counts=True)[1]


def test_a_fragment_many_texts_continue_differently_is_dealt_over_all_buckets():
    count, met = shares(900, hot=1 << 20)
    assert met.max() > 250  # so many texts of one context would meet in a task
    count, met = shares(900, hot=50)
    assert met.max() <= 50 and count.max() < 0.3 * count.sum()


def test_sorting_in_chunks_gives_the_same():
    rng = np.random.default_rng(3)
    some = rng.integers(97, 99, (6, 70)).astype(np.uint8)
    texts = [some[i % 6][i % 2: i % 2 + 60].copy() for i in range(40)]
    for t in texts[::3]:
        t[rng.integers(0, 60)] = 120
    key = np.sort(rng.integers(0, 5, 40)).astype(np.uint64)
    numbers = (key, rng.permutation(40), 100 * np.arange(40), np.full(40, 20), np.full(40, 11))
    blob = b"".join(np.asarray(x).astype(t).tobytes() for x, t in zip(numbers, suffix._NUMBERS))
    table = suffix._rows([(0, 0, suffix._STRINGS, 40, blob, b"".join(t.tobytes() for t in texts))], suffix._BYTES)
    (first, last), = suffix._sort_edges(table, 50)
    got = {int(x) for a, b in zip(np.frombuffer(first, "<u4"), np.frombuffer(last, "<u4")) for x in range(a, b + 1)}
    least = {}
    for k, d, t in zip(key, numbers[1], texts):
        for j in range(11):
            s = (k, j, t[j: j + 50].tobytes())
            least[s] = min(d, least.get(s, d))
    assert got and got == {100 * i + j for i, (k, d, t) in enumerate(zip(key, numbers[1], texts)) for j in range(11)
                   if least[k, j, t[j: j + 50].tobytes()] < d}
    assert suffix._sort_edges(table, 50, chunk=13) == [(first, last)]


def test_spans_a_document_repeats_follow_their_first_occurrence(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines = [letters(rng.randint(20, 90)) for _ in range(12)]
    rows = [(1, lines[0] + lines[1][:55]), (2, "".join(lines[i] for i in (3, 4, 5)) + "!")]
    # Pieces of shared lines, again and again in one text, in other orders and after other letters.
    for i in range(10, 16):
        rows.append((i, "".join(rng.choice(lines)[rng.randint(0, 3):] + rng.choice(["", "?", ""]) for _ in range(60))))
    same(spark, rows + [(17, "ab" * 300), (18, "b" + "ab" * 100), (18, rows[3][1])])
