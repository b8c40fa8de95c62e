"""Collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest

from tableslice.llm import phrases

COLUMNS = "doc_id long, text string, lang string"


def expected(rows, at_least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in (1, 2, 3):
                    if i + k <= len(w):
                        f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        c = {p: a for p, a in count.items() if len(p) > 1 and a >= at_least}
        ranked = []
        for p, a in c.items():
            if any(100 * b >= 50 * a for q, b in c.items() if len(q) > len(p) and p in (q[:-1], q[1:])):
                continue
            cuts = [(floor(Fraction(10**6 * a * a, count[p[:k]] * count[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, docs):
    pick = random.Random(seed)
    words = ["a", "of", "The", "the", "Éa", "zwölf", "x y", "　", "\x1c", "b'c", "\U0001d54f", ""]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " ; "]
    return [
        (i % 50, "".join(pick.choice(words[: 3 + i % 10]) + pick.choice(ends) for _ in range(pick.randrange(60))),
         pick.choice(["en", "de", None, "und"]))
        for i in range(docs)
    ]


@pytest.mark.parametrize("words", [1 << 20, 50])
def test_counts_like_a_plain_loop(spark, spread, monkeypatch, words):
    monkeypatch.setattr(phrases, "WORDS", words)
    rows = corpus(1, 400) + [(9, None, "en"), (None, "", None), (9, "... !", "fr")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(phrases.collocations(df)) == expected(rows)
    assert found(phrases.collocations(df, top=7)) == expected(rows, top=7)


def test_slices_of_a_long_text_look_ahead(spark):
    """What a worker counts in slices comes out as if it were counted at once."""
    tokens = phrases._tokens(("a b c. " * 40 + "d\n\n\n").encode())
    def total(size):
        out = Counter()
        for i in range(0, len(tokens) - 2, size):
            for batch in phrases._stripes("en", tokens.slice(i, size + 2)):
                for r in batch.to_pylist():
                    for line in r["stripe"].split("\n"):
                        words, n = line.split("\t")
                        out[r["w1"], words] += int(n)
        return out
    assert total(1 << 20) == total(3) == total(2)  # slices of two hold no end of a piece at times
    assert total(1 << 20)["a", ""] == 40 and total(5)["a", "b c"] == 40


def test_edges(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).count() == 0
    # One pair is nearly all of a very long text, and other columns clash.
    rows = [(1, "of the " * 200_000, "en"), (2, "a b. " * 10, "de"), (3, "a b. " * 9, "fr")]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS n", "'q' AS w1", "2 AS part", "'z' AS phrase")
    assert found(phrases.collocations(df)) == expected(rows)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits, here of counts as the shuffle would deliver them."""
    big = 10**14 + 1
    def counts(docs, at_least):
        return spark.createDataFrame(
            [("en", "a", None, None, 3 * big), ("en", "b", None, None, 2 * big), ("en", "a", "b", None, big)],
            "lang string, w1 string, w2 string, w3 string, n long")
    old, phrases.merged_stripes = phrases.merged_stripes, counts
    try:
        got = phrases.collocations(spark.createDataFrame([], COLUMNS)).collect()
    finally:
        phrases.merged_stripes = old
    assert [(r["score"], r["n"]) for r in got] == [(10**6 * big * big // (6 * big * big), 5 * big)]
