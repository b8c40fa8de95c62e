"""Foreign keys between tables: checking them, and making a slice complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ClosureNotSettled
from ..functions.canonical import to_text
from ..session import cut
from ..spec import ForeignKey, SchemaSpec, SliceSpec
from .slicing import col, cut_table

DEFAULT_MAX_DEPTH = 10
EXAMPLES = 3


def _tuples(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Key tuples without a null, under other names."""
    held = reduce(Column.__and__, [col(c).isNotNull() for c in columns])
    return df.filter(held).select(*[col(c).alias(n) for c, n in zip(columns, names)])


def fk_keys(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct key tuples; a null in any part means "no reference".

    Distinct before anything else: a parent that a third of all rows point at
    becomes one row already on the map side.
    """
    return _tuples(df, columns, names or columns).distinct()


def missing_keys(child: DataFrame, parent: DataFrame | None, fk: ForeignKey) -> DataFrame:
    """Child key tuples without a parent row, named like the parent's columns.

    The referenced columns are unique in the parent, so that side needs no
    distinct.
    """
    wanted = fk_keys(child, fk.columns, fk.ref_columns)
    if parent is None:
        return wanted
    have = _tuples(parent, fk.ref_columns, fk.ref_columns)
    return wanted.join(have, list(fk.ref_columns), "left_anti")


DANGLING_SCHEMA = (
    "child string, columns string, parent string, ref_columns string, "
    "parent_in_slice boolean, missing bigint, examples array<string>"
)


def dangling_keys(
    tables: Mapping[str, DataFrame], schema: SchemaSpec
) -> DataFrame | None:
    """Every dangling key tuple of every foreign key, one row each."""
    parts = []
    for name in sorted(tables):
        spec = schema.tables[name]
        for fk in spec.foreign_keys:
            # A self-reference is satisfied within the table's own rows.
            parent = tables.get(fk.references)
            gone = missing_keys(tables[name], parent, fk)
            child_cols = [spec.require(c, "foreign key") for c in fk.columns]
            parts.append(gone.select(
                F.lit(name).alias("child"),
                F.lit(", ".join(fk.columns)).alias("columns"),
                F.lit(fk.references).alias("parent"),
                F.lit(", ".join(fk.ref_columns)).alias("ref_columns"),
                F.lit(parent is not None).alias("parent_in_slice"),
                F.array(*[to_text(col(r), c) for r, c in zip(fk.ref_columns, child_cols)])
                .alias("key"),
            ))
    return reduce(DataFrame.unionByName, parts) if parts else None


def check_references(tables: Mapping[str, DataFrame], schema: SchemaSpec,
                     examples: int = EXAMPLES) -> DataFrame:
    """Foreign keys the given rows do not satisfy: how many, and a few values.

    The smallest values are kept by a limit that runs in every map task
    before the shuffle, so no task ever holds a foreign key's full set.
    """
    fk_id = ["child", "columns", "parent", "ref_columns", "parent_in_slice"]
    rows = dangling_keys(tables, schema)
    if rows is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], DANGLING_SCHEMA)
    if not examples:
        return rows.groupBy(*fk_id).agg(F.count(F.lit(1)).alias("missing")).withColumn(
            "examples", F.array().cast("array<string>"))
    rows = cut(rows)  # the anti joins run once for both uses below
    counts = rows.groupBy(*fk_id).agg(F.count(F.lit(1)).alias("missing"))
    rank = F.row_number().over(Window.partitionBy(*fk_id).orderBy("key"))
    smallest = (
        rows.withColumn("rank", rank)
        .filter(F.col("rank") <= examples)
        .groupBy(*fk_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("kept"))
    )
    return counts.join(smallest, fk_id).select(
        *fk_id,
        "missing",
        F.transform("kept", lambda k: F.array_join(k["key"], ", ")).alias("examples"),
    )


@dataclass
class Closure:
    """A slice that satisfies its own foreign keys.

    ``tables`` holds each table's rows, ``pulled`` only those added for a
    reference, ``requested`` the key tuples looked for, by referenced columns.
    """

    tables: dict[str, DataFrame]
    pulled: dict[str, DataFrame]
    requested: dict[str, dict[tuple[str, ...], DataFrame]] = field(default_factory=dict)
    rounds: int = 0

    def report(self) -> DataFrame:
        """Rows per table, and how many of them were pulled in."""
        parts = []
        for name, rows in self.tables.items():
            parts.append(rows.agg(
                F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                F.lit(0).cast("bigint").alias("pulled"),
            ))
            if name in self.pulled:
                parts.append(self.pulled[name].agg(
                    F.lit(name).alias("table"), F.lit(0).cast("bigint").alias("rows"),
                    F.count(F.lit(1)).alias("pulled"),
                ))
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy("table").agg(
            F.sum("rows").alias("rows"), F.sum("pulled").alias("pulled")
        )


def follow_parents(
    sources: Mapping[str, DataFrame],
    schema: SchemaSpec,
    slices: Sequence[SliceSpec],
    max_depth: int = DEFAULT_MAX_DEPTH,
    add_missing_parents: bool = False,
) -> Closure:
    """Add the parent rows the slice refers to until every reference resolves.

    Works on key tuples and only on what the last round added: a round takes
    the distinct foreign keys of the newly pulled rows, removes those the slice
    or an earlier round already has, and fetches the rest from the full parent.
    The key sets are written to the checkpoint folder each round, which keeps
    the plan small; whole rows are read once, at the end.
    """
    by_name = {s.table: s for s in slices}
    if add_missing_parents:
        _add_parents(by_name, schema)
    base = {
        n: cut_table(sources[n], schema.tables[n], s) for n, s in by_name.items()
    }
    # A limited slice is a sort; its keys are reused by every round below.
    keyed = {
        n: cut(_keys_only(base[n], n, schema)) if by_name[n].limit is not None else base[n]
        for n in base
    }
    requested: dict[str, dict[tuple[str, ...], DataFrame]] = {}
    fresh: dict[str, DataFrame] = dict(keyed)
    settled = 0
    for depth in range(max_depth + 1):
        found: dict[tuple[str, tuple[str, ...]], list[DataFrame]] = {}
        for child, rows in fresh.items():
            for fk in schema.tables[child].foreign_keys:
                if fk.references not in keyed:
                    continue
                gone = missing_keys(rows, keyed[fk.references], fk)
                known = requested.get(fk.references, {}).get(fk.ref_columns)
                if known is not None:
                    gone = gone.join(known, list(fk.ref_columns), "left_anti")
                found.setdefault((fk.references, fk.ref_columns), []).append(gone)
        grown: dict[str, list[DataFrame]] = {}
        for (parent, ref), parts in found.items():
            new = reduce(DataFrame.unionByName, parts)
            new = cut(new.distinct() if len(parts) > 1 else new)
            if new.isEmpty():
                continue
            seen = requested.setdefault(parent, {})
            seen[ref] = new if ref not in seen else seen[ref].unionByName(new)
            if schema.tables[parent].foreign_keys:
                match = new.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(ref)])
                grown.setdefault(parent, []).append(
                    _keys_only(sources[parent], parent, schema).join(
                        match, [col(c) == F.col(f"__r{i}") for i, c in enumerate(ref)], "left_semi"
                    )
                )
            else:
                grown.setdefault(parent, [])
        if not grown:
            break
        if depth == max_depth:
            raise ClosureNotSettled(
                f"new parents were still found in round {max_depth}, in "
                f"{', '.join(sorted(grown))}; raise the limit or narrow the slice"
            )
        settled = depth + 1
        fresh = {n: reduce(DataFrame.unionByName, p) for n, p in grown.items() if p}
        if not fresh:
            break
    pulled = {
        n: _fetch(sources[n], requested[n], by_name[n], n, schema) for n in requested
    }
    full = {
        n: rows.unionByName(pulled[n]) if n in pulled else rows for n, rows in base.items()
    }
    return Closure(full, pulled, requested, settled)


def _add_parents(by_name: dict[str, SliceSpec], schema: SchemaSpec) -> None:
    todo = list(by_name)
    while todo:
        for fk in schema.tables[todo.pop()].foreign_keys:
            if fk.references in schema.tables and fk.references not in by_name:
                by_name[fk.references] = SliceSpec(fk.references, where="false")
                todo.append(fk.references)


def _keys_only(df: DataFrame, name: str, schema: SchemaSpec) -> DataFrame:
    """Only the columns some foreign key uses, on either side."""
    spec = schema.tables[name]
    used = {c for fk in spec.foreign_keys for c in fk.columns}
    used |= {
        c for t in schema.tables.values() for fk in t.foreign_keys
        if fk.references == name for c in fk.ref_columns
    }
    used = used or set(spec.primary_key) or {spec.column_names[0]}
    return df.select(*[col(c) for c in spec.column_names if c in used and c in df.columns])


def _fetch(source: DataFrame, by_ref, slc: SliceSpec, name: str, schema: SchemaSpec) -> DataFrame:
    """Full rows of the requested keys, each row once."""
    everything = SliceSpec(
        name, columns=slc.columns, exclude_columns=slc.exclude_columns, load=slc.load
    )
    parts, taken = [], []
    for ref, keys in by_ref.items():
        rows = source
        for other, known in taken:
            rows = rows.join(known, list(other), "left_anti")
        parts.append(rows.join(keys, list(ref), "left_semi"))
        taken.append((ref, keys))
    rows = reduce(DataFrame.unionByName, parts)
    return cut_table(rows, schema.tables[name], everything)


def ancestors(
    rows: DataFrame, parent_of: DataFrame, fk: ForeignKey, key: Sequence[str],
    max_depth: int = DEFAULT_MAX_DEPTH,
) -> DataFrame:
    """Keys reachable upwards from ``rows`` over one self-reference.

    ``parent_of`` is the whole table.  Returns the key tuples of the starting
    rows and all their ancestors, named like ``fk.ref_columns``.
    """
    ref = list(fk.ref_columns)
    have = cut(fk_keys(rows, ref))
    frontier = have
    full = parent_of.select(*{c: col(c) for c in [*ref, *fk.columns, *key]}.values())
    for depth in range(max_depth + 1):
        match = frontier.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(ref)])
        at = full.join(match, [col(c) == F.col(f"__r{i}") for i, c in enumerate(ref)], "left_semi")
        new = cut(fk_keys(at, fk.columns, ref).join(have, ref, "left_anti"))
        if new.isEmpty():
            return have
        if depth == max_depth:
            raise ClosureNotSettled(f"ancestors did not settle after {max_depth} rounds")
        have, frontier = have.unionByName(new), new
    return have
