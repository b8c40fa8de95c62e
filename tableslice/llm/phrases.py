"""Phrases of two and three words that stick together, by merged stripes.

A stripe belongs to a word: an associative counter of what follows it, nested
once more for the word after that, with the totals of each prefix in it::

    w1: 70   ->  w2: 41  ->  {w3: 12, w4: 3}

Every task builds stripes of the text it reads, so the shuffle moves each
prefix once for all its extensions, and stripes of one word are merged element
by element.  The merged structure holds all that a phrase is scored by: its
extensions, the totals of its prefixes, and the largest count of a longer
phrase that contains it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .shared import give_back

#: A stripe is dealt out in so many parts, by the hash of the next word, so that no word's is in one task.
PARTS = 16
#: Bytes of a language's text a task turns into stripes at once.
TEXT_BYTES = 4 << 20
#: Words whose three-word runs are counted at once; three word numbers then fit one 64-bit key.
WORDS = 700_000
_BITS = 21

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z become small, ends of pieces a line feed, the tab a blank.
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")

_STRIPES = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("part", pa.int32()), ("stripe", pa.string())])
_SCHEMA = "lang string, w1 string, part int, stripe string"


def _tokens(data: bytes) -> pa.Array:
    """The words of a text, and a line feed wherever a piece ends."""
    buf = np.frombuffer(data.translate(_PLAIN), np.uint8)
    solid = buf != 32
    end = buf == 10
    inside = solid & ~end
    opens = end.copy()
    opens[0] |= inside[0]
    opens[1:] |= inside[1:] & ~inside[:-1]
    kept = buf[solid]
    place = np.cumsum(solid, dtype=np.int32 if len(buf) < 1 << 31 else np.int64)
    offsets = np.append(place[opens].astype(np.int64) - 1, len(kept))
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), len(change))


def _lines(codes: list[pa.Array], n: np.ndarray) -> pa.Array:
    """Entries of a stripe: the next words, a tab, how often."""
    said = pc.binary_join_element_wise(*codes, " ", null_handling="skip") if codes else pa.repeat("", len(n))
    return pc.binary_join_element_wise(said, pa.array(n).cast(pa.string()), "\t")


def _stripes(lang: str, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
    """Stripes of the words before the last two tokens, which are only looked ahead to.

    In the shuffle a stripe is text, an entry a line; words hold no blank, tab or
    line feed.  The entry without a word is the total of the prefix.
    """
    coded = tokens.dictionary_encode()
    values = coded.dictionary
    part = np.fromiter((zlib.crc32(v) % PARTS for v in values.to_pylist()), np.int32, len(values))
    # Number the words by part, so that one sort brings the parts of a stripe together.
    order = np.argsort(part, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    part = part[order]
    words = values.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
    code = number[coded.indices.to_numpy()]
    none = (1 << _BITS) - 1  # sorts last
    at = values.index(pa.scalar(b"\n", values.type)).as_py()
    if at >= 0:
        code[code == number[at]] = none
    first, second, third = code[:-2], code[1:-1], code[2:]
    third = np.where(second == none, none, third)
    key, n = np.unique((first << 2 * _BITS | second << _BITS | third)[first != none], return_counts=True)
    if not len(key):
        return
    a, b, c = key >> 2 * _BITS, key >> _BITS & none, key & none
    upto = np.concatenate(([0], np.cumsum(n)))

    def named(codes):
        return words.take(pa.array(codes, mask=codes == none))

    # How often each word occurs: its total.
    runs = _runs(a)
    heads = a[runs[:-1]]
    yield pa.record_batch([
        pa.repeat(lang, len(heads)), named(heads), pa.repeat(pa.scalar(0, pa.int32()), len(heads)),
        _lines([], np.diff(upto[runs]))], schema=_STRIPES)

    # The words after it, each with its total and the words after that.
    here = b != none
    a, b, c, n = a[here], b[here], c[here], n[here]
    if not len(a):
        return
    pairs = _runs(a, b)
    upto = np.concatenate(([0], np.cumsum(n)))
    pair_of = np.repeat(np.arange(len(pairs) - 1), np.diff(pairs))
    on = c != none
    owner = np.concatenate((np.arange(len(pairs) - 1), pair_of[on]))
    by_pair = np.argsort(owner, kind="stable")
    third = np.concatenate((np.full(len(pairs) - 1, none), c[on]))[by_pair]
    count = np.concatenate((np.diff(upto[pairs]), n[on]))[by_pair]
    second = b[pairs[:-1]][owner[by_pair]]
    lines = _lines([named(second), named(third)], count)
    first = a[pairs[:-1]][owner[by_pair]]
    stripes = _runs(first, part[second])
    heads = stripes[:-1]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(stripes, pa.int32()), lines), "\n")
    yield pa.record_batch([pa.repeat(lang, len(heads)), named(first[heads]), pa.array(part[second[heads]]), joined], schema=_STRIPES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    def flush(lang):
        tokens = _tokens(b"\n".join([*held.pop(lang), b"\n\n\n"]))
        del sizes[lang]
        for i in range(0, len(tokens) - 2, WORDS):
            for found in _stripes(lang, tokens.slice(i, WORDS + 2)):
                for j in range(0, found.num_rows, 20_000):
                    yield found.slice(j, 20_000)
    for batch in batches:
        texts = batch["text"].cast(pa.binary()) if batch["text"].type == pa.string() else batch["text"].cast(pa.large_binary())
        for lang, text in zip(batch["lang"].to_pylist(), texts):
            held.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
            if sizes[lang] >= TEXT_BYTES:
                yield from flush(lang)
        while sum(sizes.values()) >= 2 * TEXT_BYTES:
            yield from flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from flush(lang)
    give_back()


def merged_stripes(docs: DataFrame, at_least: int) -> DataFrame:
    """``lang, w1, w2, w3, n``: all words, and the pairs and triples that occur ``at_least`` times.

    Words a row does not have are null.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    stripes = texts.mapInArrow(_read, _SCHEMA).repartition("lang", "w1", "part")
    # Element by element, where the stripe has come to: no further shuffle.
    said = F.substring_index("line", "\t", 1)
    words = F.split("next", " ")
    return (
        stripes.select("lang", "w1", "part", F.explode(F.split("stripe", "\n")).alias("line"))
        .groupBy("lang", "w1", "part", said.alias("next"))
        .agg(F.sum(F.substring_index("line", "\t", -1).cast("long")).alias("n"))
        .filter((F.col("next") == "") | (F.col("n") >= at_least))
        .select("lang", "w1", F.nullif(words[0], F.lit("")).alias("w2"), F.get(words, F.lit(1)).alias("w3"), "n")
    )


def collocations(docs: DataFrame, at_least: int = 10, subsumed: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line
    ends, and those into words at blanks and tabs.  Candidates are runs of two
    or three words that occur ``at_least`` times (``a``), overlaps included.  A
    candidate cut in two parts, which occur ``l`` and ``r`` times, scores
    ``floor(1000000 * a * a / (l * r))``; its weakest cut counts, and the first
    of equally weak ones.  Candidates inside a longer one that occurs at least
    ``subsumed`` percent as often are left out.  Ranks follow score, count and
    the phrase's bytes.

    A null text is empty, a null language ``und``; neither ids nor other columns
    are read, and repeated rows count again.  Languages without a candidate have
    no row.  Counts below 10**16 are computed exactly (in decimals of 38 digits).
    """
    counted = cut(merged_stripes(docs, at_least))
    singles = counted.filter("w2 IS NULL")
    totals = singles.groupBy("lang").agg(F.sum("n").alias("total"))
    f1 = singles.filter(F.col("n") >= at_least).select("lang", F.col("w1").alias("w"), F.col("n").alias("f"))
    f2 = counted.filter("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "n")
    f3 = counted.filter("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", "n")

    def with_word(df, word, name):
        return df.join(f1.select("lang", F.col("w").alias(word), F.col("f").alias(name)), ["lang", word])

    def with_pair(df, x, y, name):
        return df.join(f2.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("n").alias(name)), ["lang", x, y])

    # Of each pair the most frequent triple it begins or ends.
    longer = (
        f3.select("lang", "w1", "w2", "n").unionAll(f3.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
        .groupBy("lang", "w1", "w2").agg(F.max("n").alias("longest"))
    )
    pairs = with_word(with_word(f2, "w1", "l"), "w2", "r").join(longer, ["lang", "w1", "w2"], "left")
    kept = pairs.filter(F.coalesce(100 * F.col("longest") < subsumed * F.col("n"), F.lit(True)))
    triples = with_word(with_word(with_pair(with_pair(f3, "w1", "w2", "l2"), "w2", "w3", "r1"), "w1", "l1"), "w3", "r2")

    def score(left, right):
        def d(c):
            return F.col(c).cast("decimal(19,0)")
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (d("n") * d("n")), d(left) * d(right))

    one = kept.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", score("l", "r").alias("score"))
    cuts = triples.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    def weaker(first, second):
        return F.when(F.col("s1") <= F.col("s2"), F.col(first)).otherwise(F.col(second))
    two = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
        weaker("l1", "l2").alias("l"), weaker("r1", "r2").alias("r"), weaker("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = one.unionAll(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def collocations_sql() -> str:
    """The contract's phrases in SQL."""
    return """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
runs AS (SELECT lang, unnest(list_transform(range(1, 1 + least(3, len(w) - i + 1)), lambda k: w[i:i + k - 1])) AS p FROM words),
f AS MATERIALIZED (SELECT lang, p, count(*) AS n FROM runs GROUP BY lang, p),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT lang, p, n AS a FROM f WHERE len(p) > 1 AND n >= 10),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
scored AS (
  SELECT c.lang, c.p, a, x.n AS l, y.n AS r, k,
         ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, q, max(a) AS longest FROM (
             SELECT lang, a, unnest([p[1:2], p[2:3]]) AS q FROM c WHERE len(p) = 3) GROUP BY lang, q),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.q = w.p
         WHERE longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (
             PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
