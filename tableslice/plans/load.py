"""Whole jobs over several tables: cut a slice, plan a load, load it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SHOWN, MergeConflict, ReadOnlyTarget, SpecError, more
from ..operators.checks import check_rows, row_violations, unique_violations, verify_tables
from ..operators.counts import next_identity, row_counts
from ..operators.diff import diff_counts, row_diff
from ..operators.digest import table_digests
from ..operators.drift import gate
from ..operators.graph import load_order
from ..operators.merge import merge_table
from ..operators.refs import DEFAULT_MAX_DEPTH, check_references, follow_parents
from ..operators.slicing import cut_table
from ..sources.commit import committed, discard, publish, stage_tables
from ..spec import SchemaSpec, SliceSpec, merge_key, selected_columns

#: The table of a commit that records ``table, rows, sha256`` of the others.
RECORD = "_record"

PLAN_SCHEMA = (
    "position int, table string, mode string, key array<string>, columns array<string>, "
    "destructive boolean"
)


def load_plan(seeds: Mapping[str, DataFrame], schema: SchemaSpec,
              slices: Sequence[SliceSpec]) -> DataFrame:
    """Tables in load order with rows, mode, key and columns.

    The plan itself has one line per table; the counts are one job.
    """
    by_name = {s.table: s for s in slices}
    order = load_order(schema, by_name).tables
    spark = next(iter(seeds.values())).sparkSession
    lines = spark.createDataFrame([
        (i, n, by_name[n].load, list(merge_key(schema.tables[n], by_name[n])),
         [c.name for c in selected_columns(schema.tables[n], by_name[n])
          if c.name in seeds[n].columns],
         by_name[n].load == "truncate_first")
        for i, n in enumerate(order, 1)
    ], PLAN_SCHEMA)
    return row_counts({n: seeds[n] for n in order}).join(F.broadcast(lines), "table").select(
        "position", "table", "rows", "mode", "key", "columns", "destructive")


@dataclass
class Export:
    tables: dict[str, DataFrame]
    report: DataFrame
    dangling: DataFrame


def cut_slice(
    sources: Mapping[str, DataFrame], schema: SchemaSpec, slices: Sequence[SliceSpec],
    with_parents: bool = False, max_depth: int = DEFAULT_MAX_DEPTH,
    add_missing_parents: bool = False, drift: DataFrame | None = None, confirmed: bool = False,
) -> Export:
    """Cut every table, pull in parents if asked, and check references.

    ``drift`` (of ``schema_drift``) is put to the slices' policies before anything
    is read.
    """
    if drift is not None:
        gate(drift, slices, confirmed)
    if with_parents:
        closure = follow_parents(sources, schema, slices, max_depth, add_missing_parents)
        tables, report = closure.tables, closure.report()
    else:
        tables = {s.table: cut_table(sources[s.table], schema.tables[s.table], s) for s in slices}
        report = row_counts(tables).withColumn("pulled", F.lit(0).cast("bigint"))
    return Export(tables, report, check_references(tables, _carried(schema, tables)))


def export_slice(export: Export, root: str, allow_dangling: bool = False,
                 schema: SchemaSpec | None = None) -> dict[str, str]:
    """Stage a slice, check the staged files, publish it.

    Each table is evaluated once.  With ``schema`` references are checked over
    the files, and a record of rows and digests (``RECORD``) is part of the same
    commit; without it the slice's own check is asked first.  A slice with
    dangling references is refused and its files are removed.
    """
    if not allow_dangling and schema is None:
        _refuse_dangling(export.dangling)
    spark = next(iter(export.tables.values())).sparkSession
    paths = stage_tables(export.tables, root)
    try:
        if not allow_dangling and schema is not None:
            _refuse_dangling(check_references(_staged(spark, root, paths), _carried(schema, export.tables)))
        if schema is not None:
            record = table_digests(_staged(spark, root, paths), schema.tables)
            paths = paths | stage_tables({RECORD: record}, root)
    except BaseException:
        discard(spark, root, paths)
        raise
    return publish(spark, root, paths, keep_others=False)


def verify_export(spark: SparkSession, root: str, schema: SchemaSpec,
                  tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Problems of ``tables`` (the committed ones by default) against the record of the newest commit."""
    paths = committed(spark, root)
    if RECORD not in paths:
        raise SpecError(f"the commit below {root} has no record; export with a schema")
    if tables is None:
        tables = {n: spark.read.parquet(p) for n, p in paths.items() if n != RECORD}
    return verify_tables(tables, schema.tables, spark.read.parquet(paths[RECORD]))


def _staged(spark: SparkSession, root: str, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{p}") for n, p in paths.items()}


def _carried(schema: SchemaSpec, tables: Mapping[str, DataFrame]) -> SchemaSpec:
    """The schema with only those references whose columns the tables carry."""
    return SchemaSpec(
        {n: replace(t, foreign_keys=tuple(
            f for f in t.foreign_keys if n in tables and set(f.columns) <= set(tables[n].columns)))
         for n, t in schema.tables.items()}, schema.enums)


def _refuse_dangling(dangling: DataFrame) -> None:
    worst = dangling.orderBy("child", "columns").limit(SHOWN).collect()
    if worst:
        raise MergeConflict("references without a parent row: " + "; ".join(
            f"{r['child']}({r['columns']}) -> {r['parent']}: {r['missing']}, "
            f"e.g. {', '.join(r['examples'])}" for r in worst) + more(dangling, worst))


def _refuse(violations: DataFrame) -> None:
    worst = violations.orderBy("table", "rule", "column", "key").limit(SHOWN).collect()
    if worst:
        raise MergeConflict("; ".join(
            f"table {r['table']}: {r['rule']} on {r['column']} for key ({r['key']})" for r in worst
        ) + more(violations, worst))


def load_violations(merged: Mapping[str, DataFrame], schema: SchemaSpec) -> DataFrame:
    """What merged tables break of their constraints: nulls, lengths, labels, keys and unique keys.

    A default only fills what is inserted, so a NULL in a NOT NULL column counts
    here also where the column has one.
    """
    parts = []
    for name, df in merged.items():
        spec = schema.tables[name]
        strict = replace(spec, columns=tuple(replace(c, default=None, has_default=False) for c in spec.columns))
        parts += [row_violations(df, strict), unique_violations(df, spec)]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Load:
    """What a load did, or with ``dry_run`` would do."""

    plan: DataFrame
    results: DataFrame | None = None
    identities: DataFrame | None = None
    changes: DataFrame | None = None
    paths: dict[str, str] | None = None


def load(
    targets: Mapping[str, DataFrame], seeds: Mapping[str, DataFrame], schema: SchemaSpec,
    slices: Sequence[SliceSpec], root: str, dry_run: bool = False, read_only: bool = False,
    allow_truncate: Sequence[str] = (), drift: DataFrame | None = None, confirmed: bool = False,
) -> Load:
    """Check the seeds, merge and stage all tables, check what is staged, publish together.

    Every merge is evaluated once, into files nobody sees yet; constraints and
    references are checked over those files.  A failure removes them and leaves
    the last commit in place.  Tables that would be emptied must be named in
    ``allow_truncate``; ``drift`` (of ``schema_drift``) must pass the slices'
    policies first.
    """
    if read_only and not dry_run:
        raise ReadOnlyTarget("the target is read-only")
    if drift is not None:
        gate(drift, slices, confirmed)
    by_name = {s.table: s for s in slices}
    plan = load_plan(seeds, schema, slices)
    if dry_run:
        diffs = {
            n: row_diff(seeds[n], targets[n], schema.tables[n], by_name[n]) for n in by_name
        }
        keyed = {n: d for n, d in diffs.items() if d is not None}
        return Load(plan, changes=diff_counts(keyed) if keyed else None)
    emptied = [s.table for s in slices if s.load == "truncate_first" and s.table not in allow_truncate]
    if emptied:
        raise MergeConflict(f"loading would empty {', '.join(emptied)}; allow it by name")
    _refuse(reduce(DataFrame.unionByName, [
        check_rows(seeds[n], schema.tables[n], by_name[n]) for n in by_name]))
    spark = next(iter(seeds.values())).sparkSession
    merged = {
        n: merge_table(targets[n], seeds[n], schema.tables[n], by_name[n])
        for n in load_order(schema, by_name).tables
    }
    paths = stage_tables(merged, root)
    try:
        staged = _staged(spark, root, paths)
        _refuse(load_violations(staged, schema))
        _refuse_dangling(check_references({**targets, **staged}, schema))
        results = _results(seeds, targets, staged, by_name)
        identities = _identities(staged, schema)
    except BaseException:
        discard(spark, root, paths)
        raise
    return Load(plan, results=results, identities=identities, paths=publish(spark, root, paths))


def _results(seeds: Mapping[str, DataFrame], targets: Mapping[str, DataFrame], staged: Mapping[str, DataFrame],
             slices: Mapping[str, SliceSpec]) -> DataFrame:
    """``table, mode, rows, affected, deleted``, from row counts: no merge is evaluated again.

    One row per table; taken now, since a later prune may remove the targets.
    """
    def counted(tables):
        return {r["table"]: r["rows"] for r in row_counts({n: tables[n] for n in seeds}).collect()}

    given, before, after = counted(seeds), counted(targets), counted(staged)
    rows = []
    for n, slc in slices.items():
        mode = slc.load
        affected = after[n] - before[n] if mode == "skip_existing" else given[n]
        rows.append((n, mode, given[n], affected, before[n] if mode == "truncate_first" else 0))
    spark = next(iter(seeds.values())).sparkSession
    return spark.createDataFrame(rows, "table string, mode string, rows long, affected long, deleted long")


def _identities(staged: Mapping[str, DataFrame], schema: SchemaSpec) -> DataFrame:
    """``table, next``: the next free number of every loaded table whose key is one whole number."""
    found = []
    for n, df in staged.items():
        key = schema.tables[n].primary_key
        if len(key) == 1 and schema.tables[n].require(key[0], "key").kind == "int":
            found.append((n, next_identity(df, key[0]).first()["next"]))
    spark = next(iter(staged.values())).sparkSession
    return spark.createDataFrame(found, "table string, next long")
