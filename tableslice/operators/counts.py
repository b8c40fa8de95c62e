"""Row counts and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slicing import col


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, rows`` for each table, in one job."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name, df in tables.items()
    ])


def status(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded against live row counts, with a note per table."""
    r = recorded.select("table", F.col("rows").alias("recorded"))
    v = live.select("table", F.col("rows").alias("live"))
    seeded, now = F.col("recorded"), F.col("live")
    note = (
        F.when(seeded == now, "in sync")
        .when(seeded.isNotNull() & now.isNotNull(),
              F.concat(F.lit("seeded "), seeded, F.lit(", live "), now))
        .when(now.isNotNull(), F.concat(F.lit("not exported, live "), now))
        .when(seeded.isNotNull(), F.concat(F.lit("seeded "), seeded, F.lit(", live unknown")))
        .otherwise("not exported")
    )
    return r.join(v, "table", "full_outer").select("table", "recorded", "live", note.alias("note"))


def next_identity(df: DataFrame, column: str) -> DataFrame:
    """The next value of an identity column: one past the largest, 1 if empty."""
    return df.agg((F.coalesce(F.max(col(column)), F.lit(0)) + 1).cast("bigint").alias("next"))


def totals(counts: DataFrame) -> DataFrame:
    """Tables and rows altogether."""
    return counts.agg(
        F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    )
