import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tableslice.llm import simhash
from tableslice.llm.shared import components, roots


def slow_fingerprint(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    fps = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    order = np.argsort(ids, kind="stable")
    back = np.argsort(order)
    label = roots(len(ids), back[a], back[b])
    return [ids[order[label[back[i]]]] for i in range(len(ids))]


def test_fingerprint_words_and_ties():
    for text in ["", "  \n", "One", "one TWO", "a b c", "A b c \x0bd Ä e f a b c", "x " * 500, None]:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_trie_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())) for _ in base], np.uint64)
    dense = (np.uint64(5) << np.uint64(40)) + np.arange(64, dtype=np.uint64)
    fps = np.unique(np.concatenate((base, base ^ flips, dense)))
    found = {(int(i), int(j)) for a, b in simhash.trie_links(fps, None, 0, 0, 3) for i, j in zip(a, b)}
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert found == {(i, j) for i, j in near.tolist() if i < j}
    half = len(fps) // 2
    cross = {(int(i), int(j)) for a, b in simhash.trie_links(fps[:half], fps[half:], 0, 0, 3) for i, j in zip(a, b)}
    assert cross == {(i, j - half) for i, j in near.tolist() if i < half <= j}


def test_near_duplicates_equal_brute_force(spark, spread):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids, fps = [r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows]
    want = {(i, format(f, "016x"), c) for i, f, c in zip(ids, fps, slow_components(ids, fps))}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", "z"), (4, "a b c d", None), (5, "A B C D", "q"),
            (5, "A B C D", "q"), (None, "a b c d", "n"), (6, "word " * 30000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(1))
    got = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (None, 4)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionAll(
        spark.createDataFrame([(1000, 1001), (1001, 1000), (7, 7)], "a long, b long"))
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
