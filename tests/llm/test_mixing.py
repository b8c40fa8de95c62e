import re
from collections import defaultdict

from compare import compare, duck

from tableslice.llm import mixing


def filled(sizes, weights):
    """Clamp and reshare round by round."""
    share, left, open_ = {}, float(sum(sizes.values())), dict(weights)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if 3 * sizes[s] < open_[s] * level]
        if not over:
            return share | {s: w * level for s, w in open_.items()}
        for s in over:
            share[s] = 3.0 * sizes[s]
            left -= share[s]
            del open_[s]
    return share


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    by_id = {i: (s, size(t)) for i, s, t in rows}
    taken = defaultdict(int)
    for r in got:
        source, n = by_id[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source])
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    for had, want in check(rows, got).values():
        assert abs(had - want) <= 0.01 * want  # some fifty documents a source here
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_sql_agrees(spark, spread):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert compare(mixing.mix(docs), duck(folder), mixing.mix_sql()) is None


def test_capped_sources_and_odd_rows(spark):
    rows = [(1, "a", "w " * 900), (2, "b", "w " * 5), (3, "b", "x"), (4, None, "y y"), (5, "c", None),
            (6, "c", ""), (7, "n", "one two"), (8, "A", "z " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr(
        "*", "'clash' AS size", "1 AS stop", "2 AS __row")
    check(rows, mixing.mix(docs).collect())
    again = mixing.repeat(docs)
    assert again.columns == docs.columns
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    seen = defaultdict(int)
    for r in again.collect():
        seen[r.doc_id] += 1
    assert all(seen[i] == n for i, n in times.items())
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(docs.filter("doc_id IN (5, 6)")).collect()} == {0}
