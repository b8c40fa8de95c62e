"""Languages of whole texts, and the spans they hold in mixed ones.

A word's script narrows the languages it can be in; each of those gives it a
score, the likelihood of its letters under a model of letter triples.  Viterbi
over the words of a text, with a penalty for going from one language to
another, labels the spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: About so many documents of a language are learnt from.
SAMPLE = 4000
#: What going over to another language costs, in natural logarithms.
SWITCH = 10.0
#: A language is a candidate in scripts that hold this share of its letters.
SCRIPT_SHARE = 0.005
#: Bytes of text worked on at once; a longer text is worked on alone.
BATCH_BYTES = 8 << 20

# First code points of the Unicode ranges told apart, with their scripts.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"),
    (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"),
    (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in _RANGES})

#: Counted letter runs: how many hash bits each kind has.  A triple and its two-letter context,
#: a pair and its one-letter context, a letter.
_BITS = (16, 14, 14, 12, 12)
_STARTS = np.concatenate(([0], np.cumsum([1 << b for b in _BITS])))
_SIZE = int(_STARTS[-1])
_WEIGHTS = (0.75, 0.2, 0.05)


class _Letters:
    """Per code point: small form, whether words hold it, script."""

    def __init__(self):
        self.small = np.arange(0x110000, dtype=np.uint32)
        inside = np.zeros(0x110000, bool)
        for i in range(0x32000):
            c = chr(i)
            kind = unicodedata.category(c)[0]
            if kind in "LM":
                inside[i] = kind == "L" or unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mc", "Mn")
                low = c.lower()
                if len(low) == 1:
                    self.small[i] = ord(low)
        self.inside = inside
        self.letter = np.zeros(0x110000, bool)
        self.letter[:0x32000] = [unicodedata.category(chr(i))[0] == "L" for i in range(0x32000)]
        starts = np.array([a for a, _ in _RANGES])
        names = np.array([SCRIPTS.index(n) for _, n in _RANGES], np.uint8)
        self.script = names[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


_TABLE: list[_Letters] = []


def _letters() -> _Letters:
    if not _TABLE:
        _TABLE.append(_Letters())
    return _TABLE[0]


@dataclass
class Words:
    """The words of several texts: each one's number, place and text, and the different words."""

    code: np.ndarray  # number of the word among the different ones
    start: np.ndarray  # code points from the start of its text
    length: np.ndarray
    text: np.ndarray  # which text it is in
    flat: np.ndarray  # the different words, two blanks before each and after the last
    ends: np.ndarray  # place in ``flat`` of the first blank after each

    @staticmethod
    def of(texts: list[str]) -> Words:
        """Words are runs of letters and their marks; runs of marks alone are none."""
        table = _letters()
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        inside = table.inside[points]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            some = np.add.reduceat(table.letter[points], start) > 0  # a run and what stands up to the next
            start, stop = start[some], stop[some]
        length = stop - start
        # The kept words' letters in one buffer, for Arrow to tell equal words.
        mark = np.zeros(len(points) + 1, np.int8)
        mark[start] += 1
        mark[stop] -= 1
        small = table.small[points[np.cumsum(mark[:-1]) > 0]]
        offsets = np.append(0, np.cumsum(length)).astype(np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(offsets * 4), pa.py_buffer(small)]).dictionary_encode()
        different = coded.dictionary
        bounds = np.frombuffer(different.buffers()[1], np.int64)[different.offset:different.offset + len(different) + 1] // 4 \
            if len(different) else np.zeros(1, np.int64)
        letters = np.frombuffer(different.buffers()[2], np.uint32)[:bounds[-1]] if len(different) else np.zeros(0, np.uint32)
        size = np.diff(bounds)
        flat = np.full(len(letters) + 2 * len(size) + 2, 32, np.uint32)
        shift = np.repeat(2 * np.arange(1, len(size) + 1), size)
        flat[np.arange(len(letters)) + shift] = letters
        text = np.searchsorted(begins, start, "right") - 1
        return Words(coded.indices.to_numpy(), start - begins[text], length, text, flat,
                     np.cumsum(size) + 2 * np.arange(1, len(size) + 1))

    def scripts(self) -> np.ndarray:
        """Script of each different word: that of its first letter."""
        first = np.append(2, self.ends[:-1] + 2) if len(self.ends) else self.ends
        return _letters().script[self.flat[first]]

    def grams(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Buckets of every letter and the blank after each word, per kind; where each word's begin."""
        valid = self.flat != 32
        valid[self.ends] = True
        at = np.flatnonzero(valid)
        c, b, a = (self.flat[at - k].astype(np.uint64) for k in range(3))

        def bucket(kind, *parts):
            h = np.zeros(len(at), np.uint64)
            for p in parts:
                h = (h + p + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return (h >> np.uint64(64 - _BITS[kind])).astype(np.int64)

        kinds = [bucket(0, a, b, c), bucket(1, a, b), bucket(2, b, c), bucket(3, b), bucket(4, c)]
        return kinds, np.append(0, np.searchsorted(at, self.ends)[:-1] + 1) if len(self.ends) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Letter counts of each language, and the scripts it is written in."""

    languages: list[str]
    counts: np.ndarray  # language x all kinds' buckets
    scripts: np.ndarray  # language x script: is it a candidate

    def scores(self, words: Words) -> np.ndarray:
        """Log-likelihood of each different word in each language; far below all where its script is not the language's."""
        kinds, begins = words.grams()
        out = np.empty((len(words.ends), len(self.languages)))
        if not len(words.ends):
            return out
        for i, counts in enumerate(self.counts):
            triple, pair_before, pair, one_before, one = (
                counts[s:e][k] for s, e, k in zip(_STARTS, _STARTS[1:], kinds))
            total = counts[_STARTS[4]:].sum()
            p = _WEIGHTS[0] * triple / np.maximum(pair_before, 1) + _WEIGHTS[1] * pair / np.maximum(one_before, 1)
            p += _WEIGHTS[2] * (one + 0.1) / (total + 0.1 * (1 << _BITS[4]))
            out[:, i] = np.add.reduceat(np.log(p), begins)
        can = self.scripts[:, words.scripts()].T
        can |= ~can.any(axis=1, keepdims=True)  # a script nobody was learnt in leaves all languages
        return np.where(can, out, out - 1e6)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word: ``scores`` of all words, text by text; ties stay, then go to the first label.

    All texts go forward together, a word at a time; longer texts stand first,
    so that those still going on are always the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    labels = np.zeros(len(scores), np.int32)
    steps = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(steps + 1), "left")  # texts with more than t words
    stays, jumps, last = [], [], np.zeros(len(sizes), np.int64)
    value = scores[starts[:going[0]]] if steps else scores
    for t in range(1, steps + 1):
        k = going[t]
        if k < len(value):
            last[k:len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        if k:
            best = value.argmax(axis=1)
            top = value[np.arange(k), best][:, None] - switch
            stays.append(value >= top)
            jumps.append(best)
            value = np.maximum(value, top) + scores[starts[:k] + t]
    now = last
    for t in range(steps - 1, -1, -1):
        k = going[t]
        labels[starts[:k] + t] = now[:k]
        if t:
            stay, jump = stays[t - 1], jumps[t - 1]
            now[:k] = np.where(stay[np.arange(k), now[:k]], now[:k], jump)
    return labels


def _labelled(model: Model, texts: list[str], switch: float) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text."""
    words, n, langs = Words.of(texts), len(texts), model.languages
    width = len(langs)
    each = model.scores(words)[words.code]
    sizes = np.bincount(words.text, minlength=n)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    labels = viterbi(each, starts[some], sizes[some], switch)
    letters = np.bincount(words.text * width + labels, words.length, n * width).reshape(n, width)
    found = letters.argmax(axis=1)
    # Spans: runs of one label in one text, and how sure each is of it.
    opens = np.flatnonzero(np.diff(words.text * width + labels, prepend=-1))
    if not len(opens):
        return [UNDETERMINED] * n, [0.0] * n, [[] for _ in texts]
    closes = np.append(opens[1:], len(labels)) - 1
    sums = np.add.reduceat(each, opens, axis=0)
    sums -= sums.max(axis=1, keepdims=True)
    own, owner = labels[opens], words.text[opens]
    sure = np.exp(sums[np.arange(len(opens)), own]) / np.exp(sums).sum(axis=1)
    weight = np.add.reduceat(words.length, opens) * sure * (own == found[owner])
    score = np.bincount(owner, weight, n) / np.maximum(letters.sum(axis=1), 1)
    spans: list[list[dict]] = [[] for _ in texts]
    begin, end = words.start[opens], words.start[closes] + words.length[closes]
    for d, a, b, x in zip(owner.tolist(), begin.tolist(), end.tolist(), own.tolist()):
        spans[d].append({"start": a, "end": b, "lang": langs[x]})
    names = [langs[f] if s else UNDETERMINED for f, s in zip(found.tolist(), sizes.tolist())]
    return names, np.minimum(score, 1.0).tolist(), spans


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_BYTES`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``text`` and ``lang`` of rows where both are given.

    About ``sample`` documents of each language are taken, by a hash of their
    text; letter counts are added up by Spark, and the driver gets one row per
    language and bucket (at most 106,496 buckets).
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, _SIZE), np.float32), np.zeros((0, len(SCRIPTS)), bool))
    share = F.create_map(*[F.lit(x) for n in languages for x in (n, min(1.0, sample / sizes[n]))])
    taken = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    index = {n: i for i, n in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(languages), _SIZE), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in _groups(batches):
            words = Words.of(batch["text"].to_pylist())
            if not len(words.code):
                continue
            lang = np.array([index[x] for x in batch["lang"].to_pylist()])[words.text]
            kinds, begins = words.grams()
            sizes = np.diff(np.append(begins, len(kinds[0])))
            script = words.scripts()
            for i in np.unique(lang):
                times = np.bincount(words.code[lang == i], minlength=len(words.ends))
                each = np.repeat(times, sizes)
                for start, bits, k in zip(_STARTS, _BITS, kinds):
                    counts[i, start:start + (1 << bits)] += np.bincount(k, each, 1 << bits).astype(np.int64)
                scripts[i] += np.bincount(script, times * (sizes - 1), len(SCRIPTS)).astype(np.int64)
        both = np.concatenate((counts, scripts), axis=1)
        lang, bucket = np.nonzero(both)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(both[lang, bucket])],
                              names=["lang", "bucket", "n"])

    found = taken.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((len(languages), _SIZE + len(SCRIPTS)), np.float32)
    both[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    scripts = both[:, _SIZE:]
    return Model(languages, both[:, :_SIZE], scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def detect(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row; whole texts are read.

    ``lang_pred`` has most letters of the text (of equals the first by code
    point), ``und`` where the text is null, has no letter or no language was
    learnt.  ``score`` is the share of the text's letters in spans of that
    language, each weighed by its likelihood against the other languages; 0 for
    ``und``.  ``spans`` are runs of words of one language, by code points, end
    exclusive.  Null ids and repeated rows are rows like others; other columns
    are not read.
    """
    id_type = docs.schema["doc_id"].dataType

    def label(batches):
        for batch in _groups(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            if model.languages:
                names, scores, spans = _labelled(model, texts, switch)
            else:
                names, scores, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            yield pa.record_batch([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)],
                                  names=["doc_id", "lang_pred", "score", "spans"])

    schema = f"doc_id {id_type.simpleString()}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return docs.select("doc_id", "text").mapInArrow(label, schema)


def third(doc_id: Column) -> Column:
    """The contract's held-out rows: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, held_out: Callable[[Column], Column] = third, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: ``doc_id, held_out, lang_pred, score, spans``.

    A null id is not held out.  Neither id, ``lang`` nor ``source`` takes part
    in a prediction.  An empty table gives no rows.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample)
    return detect(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
