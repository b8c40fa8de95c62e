"""Load modes: what a table holds after a seed has been merged into it.

Files have no row-level MERGE, so each mode returns the merged table as a new
DataFrame; the staged commit in ``sources.commit`` makes it visible.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SHOWN, MergeConflict, SpecError, more
from ..session import cut
from ..spec import SchemaSpec, SliceSpec, TableSpec, UniqueKey, merge_key
from .components import connected_components
from .refs import check_references
from .rowindex import row_index
from .slicing import col, total_order


def _align(seed: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Seed rows as rows of the target: its columns and types.

    What the seed lacks is the column's default, else NULL; an explicit NULL
    stays one.  Generated columns follow from the others.
    """
    for n in seed.columns:
        if n not in target.columns:
            raise SpecError(f"table {spec.name}: seed column {n!r} is not in the target")
    rows = seed.select(*[
        (col(n) if n in seed.columns else _default(spec, n)).cast(target.schema[n].dataType).alias(n)
        for n in target.columns
    ])
    return _computed(rows, spec)


def _default(spec: TableSpec, name: str) -> Column:
    found = spec.column(name)
    return F.expr(found.default) if found is not None and found.default is not None else F.lit(None)


def _computed(rows: DataFrame, spec: TableSpec, where: Column | None = None) -> DataFrame:
    """Generated columns from their expression; with ``where`` only in the rows it selects."""
    made = {c.name: c.computed for c in spec.columns if c.computed is not None and c.name in rows.columns}
    if not made:
        return rows
    def value(n):
        new = F.expr(made[n]).cast(rows.schema[n].dataType)
        return new if where is None else F.when(where, new).otherwise(col(n))
    return rows.select(*[value(n).alias(n) if n in made else col(n) for n in rows.columns])


def _any_null(key: Sequence[str]) -> Column:
    return reduce(Column.__or__, [col(k).isNull() for k in key])


def _nullable(spec: TableSpec, key: Sequence[str]) -> bool:
    return any(spec.require(k, "key").nullable for k in key)


#: Rows of both sides that one task of an upsert's joins sorts, and of a seed that may be held whole.
ROWS_TOGETHER = 1_000_000


def _upsert_on(target: DataFrame, seed: DataFrame, spec: TableSpec, key: Sequence[str]) -> DataFrame:
    """Upsert on a key that holds no null and repeats on neither side.

    Updates come from one join of the target to the seed, new rows from an anti
    join of the seed to the target's keys.  With a seed of up to
    ``ROWS_TOGETHER`` rows Spark picks the kind of either join from the sizes it
    knows, so a small seed does not move a large target; of the target's keys
    only those the seed has go on.  Larger seeds are joined by key in parts of
    about so many rows: the keys of a large target are small as a file, and
    Spark would hold them all in every task.  Rows and types are the same.
    """
    typed = seed.select(*[
        col(n).cast(target.schema[n].dataType).alias(n) if n in target.columns else col(n) for n in seed.columns
    ])
    rows = seed.count()
    large = rows > ROWS_TOGETHER
    if large:
        parts = -(-(rows + target.count()) // ROWS_TOGETHER)
        target, typed = (df.repartition(parts, *[col(k) for k in key]) for df in (target, typed))
    new = _align(typed, target, spec)
    seeded = [n for n in target.columns if n in seed.columns and n not in key]
    s = typed.select(
        *[col(k) for k in key], *[col(n).alias(f"__s_{n}") for n in seeded],
        F.lit(True).alias("__in_seed"),
    )
    joined = target.join(s.hint("merge") if large else s, list(key), "left_outer")
    changed = joined.select(*[
        F.when(F.col("__in_seed"), col(f"__s_{n}")).otherwise(col(n)).alias(n) if n in seeded else col(n)
        for n in target.columns
    ], "__in_seed")
    merged = _computed(changed, spec, F.coalesce(F.col("__in_seed"), F.lit(False))).drop("__in_seed")
    known = target.select(*[col(k).alias(f"__{k}") for k in key])
    if large:
        known = known.hint("merge")
    else:
        asked = typed.select(*[col(k).alias(f"__s_{k}") for k in key])
        known = known.join(asked, [col(f"__{k}") == col(f"__s_{k}") for k in key], "left_semi")
    fresh = new.join(known, [col(k) == col(f"__{k}") for k in key], "left_anti")
    return merged.unionByName(fresh)


def merge_upsert(target: DataFrame, seed: DataFrame, spec: TableSpec,
                 slc: SliceSpec | None = None) -> DataFrame:
    """Update the seed's columns of rows with its key, insert the others.

    Columns the seed does not carry keep their value.  A null in the key never
    conflicts, so such rows are set aside before the join and never shuffled:
    a key that is null in a third of all rows does not end in one task.  A
    partial unique key only matches rows its predicate selects, on both sides.
    """
    key = merge_key(spec, slc)
    if not key:
        raise SpecError(
            f"table {spec.name} has no key, so `upsert` has nothing to match on; "
            "use load='insert' or give a key"
        )
    if any(k not in seed.columns for k in key):
        raise SpecError(f"table {spec.name}: the seed lacks key column(s) of ({', '.join(key)})")
    unique = spec.conflict_target(key)
    where = unique.predicate if unique and tuple(key) != tuple(spec.primary_key) else None
    kept: list[DataFrame] = []
    if where is not None or _nullable(spec, key):
        match = ~_any_null(key)
        if where is not None:
            match = match & F.coalesce(F.expr(f"({where})"), F.lit(False))
        # A predicate may read a column the seed does not carry: NULL there.
        wide = _align(seed, target, spec)
        kept = [target.filter(~match), wide.filter(~match)]
        target = target.filter(match)
        seed = wide.filter(match).select(*[col(n) for n in seed.columns])
    merged = _upsert_on(target, seed, spec, key)
    return reduce(DataFrame.unionByName, [merged, *kept])


def _constraints(spec: TableSpec, columns: Sequence[str]) -> list[UniqueKey]:
    keys = [UniqueKey(tuple(spec.primary_key))] if spec.primary_key else []
    return [k for k in [*keys, *spec.unique] if all(c in columns for c in k.columns)]


def _covered(df: DataFrame, key: UniqueKey) -> DataFrame:
    rows = df.filter(F.expr(f"({key.predicate})")) if key.partial else df
    return rows.filter(~_any_null(key.columns))


def conflicts(target: DataFrame, seed: DataFrame, spec: TableSpec) -> DataFrame:
    """Seed keys that collide with the target or inside the seed, per constraint."""
    parts = []
    for key in _constraints(spec, seed.columns):
        names = list(key.columns)
        mine = _covered(_align(seed, target, spec), key).groupBy(*[col(n) for n in names]).agg(
            F.count(F.lit(1)).alias("seed_rows")
        )
        theirs = _covered(target, key).select(*[col(n) for n in names]).distinct()
        hit = mine.join(theirs.withColumn("__t", F.lit(True)), names, "left").filter(
            F.col("__t") | (F.col("seed_rows") > 1)
        )
        parts.append(hit.select(
            F.lit(spec.name).alias("table"), F.lit(str(key)).alias("constraint"),
            F.array_join(F.array(*[col(n).cast("string") for n in names]), ", ").alias("key"),
            "seed_rows", F.coalesce("__t", F.lit(False)).alias("in_target"),
        ))
    if not parts:
        return target.sparkSession.createDataFrame(
            [], "table string, constraint string, key string, seed_rows bigint, in_target boolean"
        )
    return reduce(DataFrame.unionByName, parts)


def merge_insert(target: DataFrame, seed: DataFrame, spec: TableSpec) -> DataFrame:
    """Plain insert; any conflict aborts before anything is written."""
    found = conflicts(target, seed, spec)
    worst = found.limit(SHOWN).collect()
    if worst:
        raise MergeConflict(
            f"table {spec.name}: "
            + "; ".join(f"{r['constraint']} = ({r['key']})" for r in worst) + more(found, worst)
            + (" already exist" if worst[0]["in_target"] else " occur twice in the seed")
        )
    return target.unionByName(_align(seed, target, spec))


def new_rows(target: DataFrame, seed: DataFrame, spec: TableSpec) -> DataFrame:
    """Seed rows that ``skip_existing`` inserts.

    A row goes if any unique constraint already holds its value in the target
    or in an earlier inserted seed row (earlier under the total order).
    """
    rows = _align(seed, target, spec)
    keys = _constraints(spec, seed.columns)
    for key in keys:
        rows = _without(rows, target, key)
    if not keys:
        return rows
    terms = total_order(spec)
    if len(keys) == 1:
        return _first_per_key(rows, keys[0], terms)
    return _first_per_keys(rows, keys, terms)


def _without(rows: DataFrame, taken: DataFrame, key: UniqueKey) -> DataFrame:
    """Rows whose value of ``key`` is not in ``taken``; uncovered rows stay."""
    names = list(key.columns)
    have = _covered(taken, key).select(*[col(n).alias(f"__{n}") for n in names])
    cond = [col(n) == col(f"__{n}") for n in names]
    if key.partial:
        cond.append(F.coalesce(F.expr(f"({key.predicate})"), F.lit(False)))
    return rows.join(have, cond, "left_anti")


def _first_per_key(rows: DataFrame, key: UniqueKey, order: Sequence[Column]) -> DataFrame:
    """The first row of each key value; the limit of one row per key runs in
    every map task before the shuffle, and rows without a value bypass it."""
    covered = ~_any_null(key.columns)
    if key.partial:
        covered = covered & F.coalesce(F.expr(f"({key.predicate})"), F.lit(False))
    rank = F.row_number().over(
        Window.partitionBy(*[col(c) for c in key.columns]).orderBy(*order)
    )
    first = rows.filter(covered).withColumn("__rank", rank).filter(F.col("__rank") == 1)
    return first.drop("__rank").unionByName(rows.filter(~covered))


#: Key values of conflicting rows that hang together and may be settled by one task.
SETTLED_ALONE = 1_000_000


def _first_per_keys(rows: DataFrame, keys: Sequence[UniqueKey],
                    order: Sequence[Column]) -> DataFrame:
    """First-come rows under several constraints at once.

    Whether a row is taken depends on rows before it that share a value with
    it, and on those before them.  So rows are parted into groups that share
    values, directly or through others; a group is gone through in order by one
    task.  Most rows share nothing and are in no group.
    """
    left = cut(row_index(rows, order, "__row"))
    claims = []
    for i, key in enumerate(keys):
        mine = _covered(left, key).select("__row", *[col(c).alias(f"__v{j}") for j, c in enumerate(key.columns)])
        values = [f"__v{j}" for j in range(len(key.columns))]
        shared = mine.groupBy(*values).agg(F.min("__row").alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        claims.append(mine.join(shared, values).select(F.col("__row").alias("row"), F.lit(i).alias("key"), "value"))
    losers = _losers(cut(reduce(DataFrame.unionByName, claims)))
    return left.join(losers.withColumnRenamed("row", "__row"), "__row", "left_anti").drop("__row")


def _losers(claims: DataFrame) -> DataFrame:
    """``row`` of those that claim a value (``key, value``) a row before them got.

    Groups of more than ``SETTLED_ALONE`` claims go in rounds: rows that are
    first in all they claim are taken, those they exclude lose, and what is left
    falls into groups again.
    """
    lost: list[DataFrame] = []
    while True:
        heads = claims.groupBy("key", "value").agg(F.min("row").alias("head"))
        links = claims.join(heads, ["key", "value"]).select("row", "head")
        groups = connected_components(links, "row", "head").withColumnRenamed("node", "row")
        grouped = cut(claims.join(groups, "row"))
        large = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SETTLED_ALONE)
        small = grouped.join(large, "root", "left_anti")
        lost.append(
            small.repartition("root").sortWithinPartitions("root", "row").select("root", "row", "key", "value")
            .mapInArrow(_in_order, "row long"))
        claims = cut(grouped.join(large, "root", "left_semi").select("row", "key", "value"))
        for _ in range(3):
            if claims.isEmpty():
                return reduce(DataFrame.unionByName, lost)
            heads = claims.groupBy("key", "value").agg(F.min("row").alias("head"))
            taken = claims.join(heads, ["key", "value"]).groupBy("row").agg(
                F.bool_and(F.col("row") == F.col("head")).alias("first")).filter("first").select("row")
            taken = cut(taken)
            gone = claims.join(taken, "row", "left_semi").select("key", "value")
            rest = claims.join(taken, "row", "left_anti")
            beaten = cut(rest.join(gone, ["key", "value"], "left_semi").select("row").distinct())
            lost.append(beaten)
            claims = cut(rest.join(beaten, "row", "left_anti"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lose, of groups that come one after another, each in row order."""
    group, row, wants, got = None, None, [], set()

    def settle():
        if any(w in got for w in wants):
            return [row]
        got.update(wants)
        return []

    for batch in batches:
        out = []
        for root, r, key, value in zip(*[c.to_pylist() for c in batch.columns]):
            if r != row:
                out += settle()
                row, wants = r, []
                if root != group:
                    group, got = root, set()
            wants.append((key, value))
        yield pa.record_batch([pa.array(out, pa.int64())], names=["row"])
    yield pa.record_batch([pa.array(settle(), pa.int64())], names=["row"])


def merge_skip_existing(target: DataFrame, seed: DataFrame, spec: TableSpec) -> DataFrame:
    """Insert, leaving out rows that any unique constraint already knows."""
    return target.unionByName(new_rows(target, seed, spec))


def merge_truncate_first(target: DataFrame, seed: DataFrame, spec: TableSpec) -> DataFrame:
    """The seed replaces the table."""
    return _align(seed, target, spec)


def merge_table(target: DataFrame, seed: DataFrame, spec: TableSpec, slc: SliceSpec) -> DataFrame:
    if slc.load == "upsert":
        return merge_upsert(target, seed, spec, slc)
    if slc.load == "insert":
        return merge_insert(target, seed, spec)
    if slc.load == "skip_existing":
        return merge_skip_existing(target, seed, spec)
    return merge_truncate_first(target, seed, spec)


DOCUMENT_MODES = ("replace", "insert", "set_on_insert")


def _one_per_id(seed: DataFrame, id_column: str, order: Sequence[str], last: bool) -> DataFrame:
    """The first or last document of each id; one per id leaves every map task."""
    terms = [col(n) for n in order] or [F.col("__at")]
    terms = [t.desc_nulls_first() if last else t.asc_nulls_last() for t in terms]
    rank = F.row_number().over(Window.partitionBy(col(id_column)).orderBy(*terms))
    placed = seed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__rank", rank)
    return placed.filter("__rank = 1").drop("__at", "__rank")


def merge_documents(target: DataFrame, seed: DataFrame, mode: str = "replace",
                    id_column: str = "_id", order: Sequence[str] = ()) -> DataFrame:
    """Whole documents by id: replaced, inserted, or only inserted if new.

    Unlike an upsert, ``replace`` keeps nothing of the old document.  Where the
    seed repeats an id, its last document counts for ``replace``, its first for
    ``set_on_insert``, and ``insert`` refuses.  ``order`` names the columns that
    say which is first; without it that is the order in which the seed is read.
    """
    if mode not in DOCUMENT_MODES:
        raise SpecError(f"unknown document mode {mode!r}")
    if mode == "insert":
        twice = seed.groupBy(col(id_column).alias("__id")).count().filter("count > 1")
        repeated = twice.limit(SHOWN).collect()
        if repeated:
            raise MergeConflict(
                "document(s) given twice: " + ", ".join(repr(r["__id"]) for r in repeated) + more(twice, repeated))
    else:
        seed = _one_per_id(seed, id_column, order, last=mode == "replace")
    ids = seed.select(col(id_column).alias("__id")).distinct()
    have = target.select(col(id_column).alias("__id"))
    if mode == "replace":
        kept = target.join(ids, col(id_column) == F.col("__id"), "left_anti")
        return kept.unionByName(seed, allowMissingColumns=True)
    if mode == "insert":
        known = seed.join(have, col(id_column) == F.col("__id"), "left_semi")
        clash = known.limit(SHOWN).collect()
        if clash:
            raise MergeConflict(
                "document(s) already there: " + ", ".join(repr(r[id_column]) for r in clash) + more(known, clash))
        return target.unionByName(seed, allowMissingColumns=True)
    fresh = seed.join(have, col(id_column) == F.col("__id"), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


@dataclass
class MergeOutcome:
    """Merged tables, and the references they do not satisfy."""

    tables: dict[str, DataFrame]
    dangling: DataFrame
    results: DataFrame


def merge_tables(
    targets: Mapping[str, DataFrame], seeds: Mapping[str, DataFrame], schema: SchemaSpec,
    slices: Mapping[str, SliceSpec],
) -> MergeOutcome:
    """Merge several tables and check references over the merged set.

    References are checked once, after all merges, so neither the order of the
    tables nor a cycle among them matters to the result.
    """
    merged = dict(targets)
    for name, seed in seeds.items():
        merged[name] = merge_table(targets[name], seed, schema.tables[name], slices[name])
    results = reduce(DataFrame.unionByName, [
        merge_result(targets[n], seeds[n], schema.tables[n], slices[n]) for n in seeds
    ])
    return MergeOutcome(merged, check_references(merged, schema), results)


def merge_result(target: DataFrame, seed: DataFrame, spec: TableSpec, slc: SliceSpec) -> DataFrame:
    """``table, mode, rows, affected, deleted`` of one table's merge."""
    zero = F.lit(0).cast("bigint")
    marks = [seed.select(F.lit(1).alias("r"), F.lit(0).alias("a"), F.lit(0).alias("d"))]
    if slc.load == "skip_existing":
        marks.append(new_rows(target, seed, spec).select(
            F.lit(0).alias("r"), F.lit(1).alias("a"), F.lit(0).alias("d")))
    else:
        marks[0] = seed.select(F.lit(1).alias("r"), F.lit(1).alias("a"), F.lit(0).alias("d"))
    if slc.load == "truncate_first":
        marks.append(target.select(F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("d")))
    return reduce(DataFrame.unionByName, marks).agg(
        F.lit(spec.name).alias("table"), F.lit(slc.load).alias("mode"),
        F.coalesce(F.sum("r"), zero).alias("rows"),
        F.coalesce(F.sum("a"), zero).alias("affected"),
        F.coalesce(F.sum("d"), zero).alias("deleted"),
    )
