"""What a load would change, row by row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import comparison_text
from ..spec import SliceSpec, TableSpec, merge_key
from .slicing import col

DIFF_SCHEMA = (
    "key array<string>, change string, "
    "changes array<struct<column:string,before:string,after:string>>"
)


# Kinds whose values Spark compares as their canonical text does, type for type.
_TYPED = frozenset({"bool", "int", "float", "decimal", "text", "bytes", "date", "timestamp"})


def _side(df: DataFrame, names: Sequence[str], prefix: str, spec: TableSpec, key: Sequence[str]) -> DataFrame:
    """Columns under ``prefix``, whether the row is there, and whether it takes part in matching.

    A partial key only matches rows of its predicate; that may read columns
    ``df`` lacks, which are NULL then.
    """
    target, match = spec.conflict_target(key), F.lit(True)
    if target is not None and target.partial and tuple(key) != tuple(spec.primary_key):
        lacking = [c for c in spec.columns if c.name not in df.columns]
        df = df.select("*", *[F.lit(None).cast(c.spark_type()).alias(c.name) for c in lacking])
        match = F.coalesce(F.expr(f"({target.predicate})"), F.lit(False))
    return df.select(
        *[col(n).alias(f"{prefix}{n}") for n in names], match.alias(f"{prefix}match"),
        F.lit(True).alias(f"{prefix}present"),
    )


def row_diff(seed: DataFrame, live: DataFrame, spec: TableSpec, slc: SliceSpec | None = None,
             exact: bool = True) -> DataFrame | None:
    """Pair seed and live rows by key and say what each seed row would change.

    ``change`` is added, updated, unchanged or, for a ``truncate_first`` load,
    removed.  Only the seed's columns are compared, and two nulls are equal.
    Rows pair as a merge pairs them: a null in the key matches nothing, so such
    seed rows are added, and a partial key only matches rows of its predicate.
    Returns None for a table without a usable key.

    Keys are joined and values compared as they are typed; text is made of what
    comes out of the join, and decides only where types differ or hold JSON.
    The key is unique on both sides, so no join key is hot.
    """
    slc = slc or SliceSpec(spec.name)
    key = merge_key(spec, slc)
    if not key or any(k not in seed.columns for k in key):
        return None
    names = list(seed.columns)
    how = "full_outer" if slc.load == "truncate_first" else "left_outer"
    kinds = {n: (seed.schema[n].dataType, live.schema[n].dataType) for n in names}
    left, right = _side(seed, names, "s_", spec, key), _side(live, names, "l_", spec, key)
    pairs = left.join(
        right,
        [F.col(f"`s_{k}`").cast(kinds[k][1]) == F.col(f"`l_{k}`") for k in key]
        + [F.col("s_match") & F.col("l_match")], how,
    )

    def text(side: str, n: str) -> Column:
        held = kinds[n][side == "l_"]
        return comparison_text(F.col(f"`{side}{n}`"), spec.require(n, "columns"), held, exact)

    def differ(n: str) -> Column:
        same = kinds[n][0] == kinds[n][1] and spec.require(n, "columns").kind in _TYPED
        a, b = (F.col(f"`s_{n}`"), F.col(f"`l_{n}`")) if same else (text("s_", n), text("l_", n))
        return ~a.eqNullSafe(b)

    moved = F.filter(
        F.array(*[
            F.when(differ(n), F.struct(
                F.lit(n).alias("column"), text("l_", n).alias("before"), text("s_", n).alias("after")))
            for n in names if n not in key
        ]) if len(names) > len(key) else F.expr(
            "cast(array() as array<struct<column:string,before:string,after:string>>)"
        ),
        lambda m: m.isNotNull(),
    )
    change = (
        F.when(F.col("s_present").isNull(), "removed")
        .when(F.col("l_present").isNull(), "added")
        .when(F.size("changes") > 0, "updated")
        .otherwise("unchanged")
    )
    both = F.col("s_present").isNotNull() & F.col("l_present").isNotNull()
    return pairs.select(
        F.array(*[F.coalesce(text("s_", k), text("l_", k)) for k in key]).alias("key"),
        "s_present", "l_present",
        F.when(both, moved).alias("changes"),
    ).select("key", change.alias("change"), "changes")


def removed_keys(seed: DataFrame, live: DataFrame, spec: TableSpec,
                 slc: SliceSpec | None = None) -> DataFrame:
    """Live key tuples the seed does not hold; only keys are read.

    A key with a null is held by no seed row.
    """
    key = merge_key(spec, slc)
    have = seed.select(*[col(k).alias(f"__{k}") for k in key])
    cond = [col(k) == F.col(f"`__{k}`") for k in key]
    return live.select(*[col(k) for k in key]).join(have, cond, "left_anti")


def diff_counts(diffs: dict[str, DataFrame | None]) -> DataFrame:
    """Added, updated, unchanged and removed rows per table, in one row each."""
    parts = [
        d.agg(
            F.lit(name).alias("table"),
            *[F.count_if(F.col("change") == c).alias(c)
              for c in ("added", "updated", "unchanged", "removed")],
        )
        for name, d in diffs.items() if d is not None
    ]
    if not parts:
        raise ValueError("no table here has a key to match rows by")
    return reduce(DataFrame.unionByName, parts)
