"""Positions of rows under a total order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .slicing import col

_IN_PARTITION = (1 << 33) - 1


def sort_rows(df: DataFrame, order: Sequence[Column], unique: bool) -> DataFrame:
    """A distributed sort that also spreads rows which are copies of each other.

    Equal sort keys all go to one task.  Under a total order only copies are
    equal, and which copy comes first does not matter; so without a key that
    rules copies out (``unique``) the rows are pinned in the checkpoint folder
    and their place there breaks the tie, the same on every retry.
    """
    if unique:
        return df.orderBy(*order)
    pinned = cut(df).withColumn("__tie", F.monotonically_increasing_id())
    return pinned.orderBy(*order, F.col("__tie")).drop("__tie")


def row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index",
              unique: bool = False) -> DataFrame:
    """Number the rows 1, 2, ... in ``order``; ``unique`` says no two rows tie.

    A distributed sort gives every row a partition and a place in it; a count
    per partition gives each partition's offset.  The sorted rows are written
    to the checkpoint folder between the two passes, so that both see the same
    partition borders even if executors are lost.  The offsets are one row per
    sort partition, which is what bounds the window and the broadcast below.
    """
    ordered = cut(
        sort_rows(df, order, unique).select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("__place"),
        )
    )
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    return ordered.join(F.broadcast(offsets), "__part").select(
        *[col(c) for c in df.columns], (F.col("__offset") + F.col("__place") + 1).alias(name)
    )


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """``row_number`` per group that stays even when one group is huge.

    Sorting by group and order spreads a large group over many partitions.  A
    row's rank is its place after its group's first row in the partition, plus
    the group's rows in earlier partitions; only groups that cross a partition
    border have such rows, at most one per partition.
    """
    ordered = cut(
        df.orderBy(*[col(g).asc_nulls_last() for g in group], *order).select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("__place"),
        )
    )
    pieces = ordered.groupBy("__part", *[col(g) for g in group]).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    last = ordered.groupBy("__part").agg(F.max("__place").alias("__end"))
    # Pieces that touch a border of their partition: at most two per partition.
    border = pieces.join(F.broadcast(last), "__part").filter(
        (F.col("__first") == 0) | (F.col("__first") + F.col("__size") - 1 == F.col("__end"))
    )
    earlier = (
        Window.partitionBy(*[col(g) for g in group])
        .orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        border.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .filter("__before > 0")
        .select("__part", F.col("__before"), *[col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    )
    # A piece is at most one partition, so this window is bounded by that.
    inside = Window.partitionBy("__part", *[col(g) for g in group]).orderBy("__place")
    ranked = ordered.withColumn("__rank", F.row_number().over(inside))
    on = [ranked["__part"] == carried["__part"]] + [
        ranked[f"`{g}`"].eqNullSafe(carried[f"__g{i}"]) for i, g in enumerate(group)
    ]
    return ranked.join(F.broadcast(carried), on, "left").select(
        *[ranked[f"`{c}`"] for c in df.columns],
        (F.col("__rank") + F.coalesce(F.col("__before"), F.lit(0))).alias(name),
    )
