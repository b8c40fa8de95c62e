"""A quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .shared import give_back, held_out

#: Expected rows of each kind, positive and unlabelled, that a model is fitted on.
SAMPLE = 6000
BINS = 400
#: Bytes of a text looked at together; a text of any length is read piece by piece.
PIECE = 1 << 20

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    b".", b",", b"!", b"?", b"$", b"%", b"#", b"&", b"*", b"|", b":;", b"'\"", b"()[]{}<>", b"-_", b"/\\+=@^~`",
]
_KINDS = len(_GROUPS) + 2  # other control characters, bytes beyond ASCII
_KIND = np.full(256, _KINDS - 2, np.int64)
_KIND[128:] = _KINDS - 1
for _i, _g in enumerate(_GROUPS):
    _KIND[list(_g)] = _i
N_FEATURES = _KINDS * _KINDS + 9


def features(text: bytes) -> np.ndarray:
    """Shares of neighbouring character kinds, and how words and lines repeat, of a whole text."""
    pairs = np.zeros(_KINDS * _KINDS, np.int64)
    for at in range(0, len(text), PIECE):
        kinds = _KIND[np.frombuffer(text[at: at + PIECE + 1], np.uint8)]
        pairs += np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=len(pairs))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    rest = [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(distinct) / n ** 0.9,
        sum(map(len, distinct)) / max(1, len(text)), len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)), float(lengths.max()) ** 0.5,
    ]
    return np.concatenate((np.sqrt(pairs / max(1, pairs.sum())), rest)).astype(np.float32)


@dataclass
class Linear:
    """A logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0, dtype=np.float64)
    square = np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)
    return mean.astype(x.dtype), (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3).astype(x.dtype)


def _descend(x_p, x_u, gradients, l2: float, steps: int, rate: float):
    """Adam over weights and bias; ``gradients`` maps the scores' logits to their derivatives."""
    w, kind = np.zeros(x_p.shape[1] + 1), x_p.dtype  # single precision halves what the driver holds
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        now = w[:-1].astype(kind)
        d_p, d_u = gradients((x_p @ now).astype(np.float64) + w[-1], (x_u @ now).astype(np.float64) + w[-1])
        push = d_p.astype(kind) @ x_p + d_u.astype(kind) @ x_u
        g = np.append(push.astype(np.float64) + l2 * w[:-1], d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_domain(p: np.ndarray, u: np.ndarray, l2: float = 1e-2, steps: int = 300, rate: float = 0.03) -> Linear:
    """Positives against unlabelled, both counting alike: what the class prior is read from."""
    mean, scale = _standard(np.concatenate((p, u)))
    x_p, x_u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))

    def gradients(z_p, z_u):
        return -0.5 * _sigmoid(-z_p) / len(z_p), 0.5 * _sigmoid(z_u) / len(z_u)

    w = _descend(x_p, x_u, gradients, l2, steps, rate)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, l2: float = 3e-4, steps: int = 800,
             rate: float = 0.03) -> Linear:
    """Minimise ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])``, l the logistic loss.

    The second part estimates the negatives' risk and cannot truly be below
    zero; where the sample makes it so, a step undoes that overfit instead.
    """
    mean, scale = _standard(u)
    x_p, x_u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    l2 += 0.2 / len(u)  # less is known from few rows

    def gradients(z_p, z_u):
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        push_p = -prior * _sigmoid(z_p) / len(z_p)
        push_u = _sigmoid(z_u) / len(z_u)
        if negative < 0:
            return -push_p, -push_u
        return push_p - prior * _sigmoid(-z_p) / len(z_p), push_u

    w = _descend(x_p, x_u, gradients, l2, steps, rate)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from histograms over rising domain scores.

    Above any border the unlabelled hold at least ``prior`` times the share of
    positives there; the border is where that bound, with its sampling error, is
    lowest.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p = np.cumsum(positive[::-1])[::-1] / max(1, n_p)
    above_u = np.cumsum(unlabelled[::-1])[::-1] / max(1, n_u)
    slack = np.sqrt(np.log(4 / delta) / 2 / max(1, n_p)) + np.sqrt(np.log(4 / delta) / 2 / max(1, n_u))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(above_p > 0, (above_u + slack) / above_p, np.inf)
        best = int(np.argmin(bound))
        return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99)) if n_p and n_u else 0.5


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int")


def _apply(docs: DataFrame, make, columns: str, kind: pa.DataType) -> DataFrame:
    """``doc_id`` and what ``make`` finds in the features of each text and the half its id falls into."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 1024):
                part = texts.slice(at, 1024)
                x = np.stack([features(t.as_py() or b"") for t in part])
                half = batch.column(2).slice(at, 1024).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1024), pa.array(list(make(x, half)), kind)], names=["doc_id", "x"])
        give_back()

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), _half(F.col("doc_id").cast("long"))
    ).mapInArrow(run, f"doc_id long, x {columns}")


def _scored(docs: DataFrame, model: Linear) -> DataFrame:
    return _apply(docs, lambda x, _: model.scores(x), "double", pa.float64())


def _chance(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("quality")), 11) / float(1 << 53)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear | None:
    """The classifier, from rows that are not held out; None where there are no positives or no other rows.

    Positives are labelled 1, unlabelled are documents without a label; labels 0
    are not used.  The models are fitted on about ``sample`` rows of each kind,
    drawn by a hash of the id (the bound is that parameter); the class prior is
    read from the domain scores of all documents.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    kind = cut(
        ids.filter(~held_out(F.col("doc_id"))).join(
            marks.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id", "left")
        .select("doc_id", F.when(F.col("quality") == 1, 1).when(F.col("quality").isNull(), 0).alias("kind"))
        .filter("kind IS NOT NULL")
    )
    n = {r["kind"]: r["count"] for r in kind.groupBy("kind").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    share = F.when(F.col("kind") == 1, F.lit(sample / n[1])).otherwise(F.lit(sample / n[0]))
    drawn = cut(kind.filter(_chance(F.col("doc_id")) < share))
    # About 2 * sample ids whatever the corpus.
    rows = docs.join(F.broadcast(drawn.select(F.col("doc_id").alias("__drawn"))),
                     F.col("doc_id") == F.col("__drawn"), "left_semi")
    found = _apply(rows, lambda x, _: x.tolist(), "array<float>", pa.list_(pa.float32()))
    got = found.join(F.broadcast(drawn), "doc_id").withColumn("half", _half(F.col("doc_id"))).orderBy("doc_id").toArrow()
    x = np.stack(got.column("x").to_numpy(zero_copy_only=False)) if got.num_rows else np.zeros((0, N_FEATURES))
    is_p = got.column("kind").to_numpy() == 1
    if not is_p.any() or is_p.all():
        return None
    # Each half of the ids is scored by the model of the other, so that no row scores itself.
    half = got.column("half").to_numpy()
    parts = [(x[is_p & (half != k)], x[~is_p & (half != k)]) for k in (0, 1)]
    domains = [fit_domain(*(part if len(part[0]) and len(part[1]) else (x[is_p], x[~is_p]))) for part in parts]
    scores = _apply(
        docs.filter("doc_id IS NOT NULL"),
        lambda f, h: np.where(h == 0, domains[0].scores(f), domains[1].scores(f)), "double", pa.float64())
    bins = (
        scores.join(kind, "doc_id")
        .groupBy("kind", F.least(F.floor(F.col("x") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    )
    counts = np.zeros((2, BINS))
    for r in bins:
        counts[r["kind"], r["bin"]] = r["count"]
    return fit_nnpu(x[is_p], x[~is_p], class_prior(counts[1], counts[0]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    ``score`` is the chance of label 1 by the text alone; ``predicted`` is 1
    from ``threshold`` on.  Null texts score like empty ones.  Rows with a null
    doc_id are scored and count as not held out.  Without positives or without
    unlabelled rows every score is 0.5.  Repeated rows score alike, an empty
    table gives no rows, other columns are ignored.
    """
    model = train(docs, labels, sample)
    if model is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("x"))
    else:
        rows = _scored(docs, model)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("x").alias("score"),
        (F.col("x") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; columns and values as they are."""
    model = train(docs, labels, sample)
    if model is None:
        return docs.filter(F.lit(0.5 >= threshold))
    columns = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            good = [bool(model.scores(features(t.as_py() or b"")[None])[0] >= threshold) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], names=["row"])

    from pyspark.sql.types import StructField, StructType

    kept = packed.mapInArrow(run, StructType([StructField("row", packed.schema["row"].dataType)]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
