"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .shared import WORD

#: Hex digits of the draw that name a slice of a source: 4096 slices.
SLICE = 3
#: Documents that may follow the border to come nearer to a target.
FITS = 3


def n_words(text: Column) -> Column:
    """Words of a whole text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source(source: Column) -> Column:
    """A key that sorts by code point, nulls last, and joins nulls with nulls."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("a"), source.cast("string")))


def _draw(doc_id: Column, seed: int) -> Column:
    return F.substring(
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 16
    )


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    Water rises by weight until a source reaches ``max_epochs`` times its size;
    that source is clamped and what it cannot take is shared by weight among the
    others.  Sources fill up in the order of cap / weight, so running sums over
    that order find the first source that is not clamped and with it the level
    of the rest: the same fixed point as clamping round by round.  The windows
    run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sizes.select(
        "source", "source_size", rank.alias("rank"), weight.alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    ).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    levels = caps.withColumn("level", level)
    reached = F.when(F.col("fills_at") >= F.col("level"), F.struct("fills_at", "rank", "level"))
    levels = levels.withColumn("at", F.min(reached).over(everything)["level"])
    target = F.least(
        F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("at"), F.col("cap").cast("double"))
    )
    return levels.select("source", "source_size", target.alias("target"))


def draws(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One row per document, and one per source and slice, that say how often each is taken.

    A source is taken whole as often as it fits into its target.  The rest is
    filled by documents in the order of a seeded draw (MD5 of seed and id), up to
    the one that would pass the target, then ``FITS`` times by the largest later
    document that still fits, and last by the one whose size is nearest to what
    is missing, if that brings the source nearer.

    No source is sorted as a whole: sizes are summed per slice of the draw, the
    slice that holds the border is found from the sums, and only its documents
    are ordered.  Joins are on source and slice, so that a source with a third of
    all rows is dealt over 4096 keys.
    """
    sized = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _source(F.col("source")).alias("source"),
        n_words(F.col("text").cast("string")).alias("size"), _draw(F.col("doc_id"), seed).alias("draw"),
    ).withColumn("slice", _slice(F.col("draw"))))
    slices = cut(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goals = targets(sizes, weights, max_epochs)
    whole = F.when(
        F.col("source_size") > 0,
        F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size"))),
    ).otherwise(0).cast("long")
    goals = cut(
        goals.withColumn("whole", whole)
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (
        slices.withColumn("upto", F.sum("slice_size").over(running)).join(goals, "source")
        .filter("upto > need AND upto - slice_size <= need")
        .select("source", "slice", "need", (F.col("upto") - F.col("slice_size")).alias("base"))
    )
    inside = Window.partitionBy("source").orderBy("draw").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    stop = (
        sized.join(border, ["source", "slice"])
        .withColumn("upto", F.col("base") + F.sum("size").over(inside)).filter("upto > need")
        .groupBy("source").agg(F.min_by("draw", F.struct("upto", "draw")).alias("stop"))
    )
    goals = goals.join(stop, "source", "left")
    gaps = (
        _by_slice(slices, goals.select("source", "stop", "need")).join(sized, ["source", "slice"])
        .filter("stop IS NOT NULL").groupBy("source", "slice", "need", "stop")
        .agg(F.coalesce(F.sum(F.when(F.col("draw") < F.col("stop"), F.col("size"))), F.lit(0)).alias("got"))
        .groupBy("source", "need", "stop").agg(F.sum("got").alias("got"))
    )
    state = cut(gaps.select(
        "source", "stop", (F.col("need") - F.col("got")).alias("gap"),
        F.array().cast("array<string>").alias("extra"),
    ))
    for k in range(FITS + 1):
        reach = F.col("gap") if k < FITS else 2 * F.col("gap") - 1
        order = F.col("size") if k < FITS else -F.abs(F.col("gap") - F.col("size"))
        fits = (F.col("draw") >= F.col("stop")) & F.col("size").between(F.lit(1), reach)
        best = (
            _by_slice(slices, state).join(sized, ["source", "slice"])
            .filter(fits & ~F.array_contains("extra", F.col("draw")))
            .groupBy("source", "slice").agg(F.max(F.struct(order.alias("o"), "draw", "size")).alias("best"))
            .groupBy("source").agg(F.max("best").alias("best"))
        )
        state = cut(state.join(best, "source", "left").select(
            "source", "stop", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
            F.concat("extra", F.array_compact(F.array("best.draw"))).alias("extra"),
        ))
    goals = goals.join(state.select("source", "extra"), "source", "left").select(
        "source", "source_size", "target", "whole", "stop", "extra"
    )
    return sized, cut(_by_slice(slices, goals))


def _slice(draw: Column) -> Column:
    return F.substring(draw, 1, SLICE)


def _by_slice(slices: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows of a source repeated for its slices, so that no join brings a whole source together."""
    return slices.select("source", "slice").join(per_source, "source")


def _times() -> Column:
    part = F.coalesce(F.col("draw") < F.col("stop"), F.lit(False)) | F.coalesce(
        F.array_contains("extra", F.col("draw")), F.lit(False)
    )
    return F.col("whole") + part.cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``size`` counts words; the targets share all sizes by weight, no target is
    above ``max_epochs`` times its source.  ``taken`` is ``size`` times the
    document's repetitions, 0 to ``max_epochs``.  Weights go round over the
    sources in code point order, null last.  Null and empty texts have size 0.
    Rows that share doc_id, source and seed are drawn together.  An empty table
    gives an empty result; other columns are ignored.  Reruns agree.
    """
    sized, goals = draws(docs, weights, max_epochs, seed)
    return sized.join(goals, ["source", "slice"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken")
    )


def repeat(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (see ``mix``)."""
    _, goals = draws(docs, weights, max_epochs, seed)
    goals = goals.select(F.col("source").alias("__source"), F.col("slice").alias("__slice"), "whole", "stop", "extra")
    columns = [docs[f"`{c}`"] for c in docs.columns]
    keyed = docs.select(
        F.struct(*columns).alias("__row"), _source(docs["source"]).alias("__source"),
        _draw(docs["doc_id"], seed).alias("draw"),
    ).withColumn("__slice", _slice(F.col("draw")))
    times = keyed.join(goals, ["__source", "__slice"]).select("__row", _times().cast("int").alias("times"))
    return times.filter("times > 0").select(
        "__row", F.explode(F.sequence(F.lit(1), F.col("times")))
    ).select(*[F.col(f"__row.`{c}`") for c in docs.columns])


_FIT_SQL = """,
e{k} AS (SELECT source, max(({order}, draw, size)) AS best FROM run JOIN g{j} USING (source)
         WHERE draw >= stop AND size BETWEEN 1 AND {reach} AND NOT list_contains(extra, draw) GROUP BY source),
g{k} AS (SELECT source, stop, gap - coalesce(best[3], 0) AS gap,
                CASE WHEN best IS NULL THEN extra ELSE list_append(extra, best[2]) END AS extra
         FROM g{j} LEFT JOIN e{k} USING (source))"""

#: The same for ``documents`` in another engine: weights 1, 2, 3, three epochs, seed 7.
_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('7:' || doc_id::VARCHAR), 1, 16) AS draw
  FROM {documents}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS rank FROM sizes),
caps AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap,
                (3 * source_size)::DOUBLE / (1 + rank % 3) AS fills_at FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills_at, rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY fills_at, rank
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
lev AS (SELECT level FROM levels WHERE fills_at >= level ORDER BY fills_at, rank LIMIT 1),
goals AS (SELECT source, source_size,
                 least(cap::DOUBLE, coalesce(weight * (SELECT level FROM lev), cap::DOUBLE)) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole
           FROM goals),
run AS (SELECT s.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS need,
               sum(size) OVER (PARTITION BY s.source ORDER BY draw
                 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM sized s JOIN epochs e USING (source)),
stops AS (SELECT source, min(draw) AS stop FROM run WHERE upto > need GROUP BY source),
g0 AS (SELECT source, stop, any_value(need) - coalesce(sum(CASE WHEN draw < stop THEN size END), 0) AS gap,
              []::VARCHAR[] AS extra
       FROM run JOIN stops USING (source) GROUP BY source, stop){extras}
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN coalesce(draw < stop, false) OR coalesce(list_contains(extra, draw), false)
                             THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run LEFT JOIN (SELECT source, stop, extra FROM g{fits}) USING (source)
"""


def mix_sql(documents: str = "documents") -> str:
    extras = "".join(
        _FIT_SQL.format(j=k, k=k + 1, order="size" if k < FITS else "-abs(gap - size)",
                        reach="gap" if k < FITS else "2 * gap - 1")
        for k in range(FITS + 1)
    )
    return _MIX_SQL.format(documents=documents, extras=extras, fits=FITS + 1)
