"""Row checks that run before anything is written.

Every rule yields the same columns (``VIOLATION_SCHEMA``), so rules can be put
together, counted and looked at in one place.  All row rules of a table share
one pass over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import parse_failed, to_text
from ..spec import SliceSpec, TableSpec, merge_key
from .rowindex import row_index
from .slicing import col, filter_rows, total_order

VIOLATION_SCHEMA = (
    "table string, rule string, column string, key string, value string"
)


def key_text(spec: TableSpec, key: Sequence[str], df: DataFrame) -> Column:
    """Key values as one readable text; NULL parts read ``NULL``."""
    if not key:
        return F.lit(None).cast("string")
    return F.array_join(
        F.array(*[
            F.coalesce(to_text(col(k), spec.require(k, "key"), df.schema[k].dataType), F.lit("NULL"))
            for k in key
        ]), ", ",
    )


def _hit(rule: str, column: str, bad: Column, value: Column) -> Column:
    return F.when(bad, F.struct(
        F.lit(rule).alias("rule"), F.lit(column).alias("column"),
        value.cast("string").alias("value"),
    ))


def row_rules(df: DataFrame, spec: TableSpec, parse: bool = False) -> list[Column]:
    """One column per rule: a struct where the row breaks it, else NULL."""
    rules = []
    for c in spec.writable:
        if c.name not in df.columns:
            continue
        v = col(c.name)
        if not c.nullable and not c.has_default:
            rules.append(_hit("not_null", c.name, v.isNull(), F.lit(None)))
        if c.kind == "text" and c.max_len is not None:
            n = F.char_length(v)
            rules.append(_hit("max_length", c.name, n > c.max_len, n))
        if c.labels:
            rules.append(_hit("enum_label", c.name, ~v.isin(*c.labels), v))
        if parse and c.kind != "text":
            rules.append(_hit("parse", c.name, parse_failed(v, c), v))
    return rules


def row_violations(df: DataFrame, spec: TableSpec, slc: SliceSpec | None = None,
                   parse: bool = False) -> DataFrame:
    """Null, length, label and (for text input) parse violations, in one pass.

    ``parse=True`` takes a table of text columns, as a file reader yields.
    """
    key = [k for k in merge_key(spec, slc) if k in df.columns]
    rules = row_rules(df, spec, parse)
    if not rules:
        return df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
    broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return (
        df.select(_ident(df, spec, key, parse).alias("key"), F.explode(broken).alias("hit"))
        .select(
            F.lit(spec.name).alias("table"), F.col("hit.rule").alias("rule"),
            F.col("hit.column").alias("column"), "key", F.col("hit.value").alias("value"),
        )
    )


def indexed_violations(df: DataFrame, spec: TableSpec, slc: SliceSpec | None = None,
                       parse: bool = False) -> DataFrame:
    """The violations of ``check_rows`` with the row's number under the total order.

    A row that repeats a key carries the number of the first row with it as its
    value.  ``parse=True`` takes text columns, which then sort as text.  Costs a
    sort of the whole table; ask for it when there is something to look up, not
    on every load.
    """
    slc = slc or SliceSpec(spec.name)
    numbered = row_index(df, total_order(spec, slc))
    key = [k for k in merge_key(spec, slc) if k in df.columns]
    rules = row_rules(df, spec, parse)
    parts = []
    if rules:
        hits = F.filter(F.array(*rules), lambda r: r.isNotNull())
        parts.append(numbered.select(
            "row_index", _ident(df, spec, key, parse).alias("key"), F.explode(hits).alias("hit")
        ).select(
            F.lit(spec.name).alias("table"), F.col("hit.rule").alias("rule"),
            F.col("hit.column").alias("column"), "row_index", "key", F.col("hit.value").alias("value")))
    if key and len(key) == len(merge_key(spec, slc)) and not _partial(spec, key):
        twice = _first_two(numbered.select(*[col(k) for k in key], "row_index"), key)
        parts.append(twice.select(
            F.lit(spec.name).alias("table"), F.lit("duplicate_key").alias("rule"),
            F.lit(", ".join(key)).alias("column"), F.col("second_row").alias("row_index"),
            _ident(df, spec, key, parse).alias("key"), F.col("first_row").cast("string").alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "table string, rule string, column string, row_index bigint, key string, value string")
    return reduce(DataFrame.unionByName, parts)


def _partial(spec: TableSpec, key: Sequence[str]) -> bool:
    target = spec.conflict_target(key)
    return target is not None and target.partial and tuple(key) != tuple(spec.primary_key)


def _ident(df: DataFrame, spec: TableSpec, key: Sequence[str], parse: bool) -> Column:
    if parse and key:
        return F.array_join(F.array(*[F.coalesce(col(k).cast("string"), F.lit("NULL")) for k in key]), ", ")
    return key_text(spec, key, df)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key tuples held by more than one row, and how many rows.

    Counts are combined before the shuffle; nulls in a key count as values, as
    they do within one seed file.
    """
    return (
        df.groupBy(*[col(k) for k in key])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )


def duplicate_rows(df: DataFrame, spec: TableSpec, key: Sequence[str],
                   slc: SliceSpec | None = None) -> DataFrame:
    """Each duplicate key with the numbers of its first two rows.

    The two smallest numbers per key are picked by a limit inside every map
    task, so a key with a third of all rows sends two rows per task.
    """
    return _first_two(row_index(df, total_order(spec, slc)).select(*[col(k) for k in key], "row_index"), key)


def _first_two(numbered: DataFrame, key: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy(*[col(k) for k in key]).orderBy("row_index")
    )
    first_two = numbered.withColumn("__rank", rank).filter(F.col("__rank") <= 2)
    return (
        first_two.groupBy(*[col(k) for k in key])
        .agg(
            F.min("row_index").alias("first_row"), F.max("row_index").alias("second_row"),
            F.count(F.lit(1)).alias("__n"),
        )
        .filter(F.col("__n") == 2).drop("__n")
    )


def key_violations(df: DataFrame, spec: TableSpec, slc: SliceSpec | None = None) -> DataFrame:
    """Duplicates of the merge key inside one seed.

    A partial key may repeat outside its predicate, and where it holds a null.
    """
    key = merge_key(spec, slc)
    if not key or any(k not in df.columns for k in key):
        return df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
    target = spec.conflict_target(key)
    rows = df
    if target is not None and target.partial and key != spec.primary_key:
        # The predicate may read columns the seed lacks: NULL there.
        lacking = [c.name for c in spec.columns if c.name not in df.columns]
        rows = df.select("*", *[F.lit(None).cast(spec.require(n, "key").spark_type()).alias(n) for n in lacking])
        rows = filter_rows(rows, target.predicate).dropna("any", subset=list(key))
    return _as_violations(duplicate_keys(rows, key), rows, spec, key, "duplicate_key")


def _as_violations(dups: DataFrame, df: DataFrame, spec: TableSpec, key: Sequence[str],
                   rule: str) -> DataFrame:
    return dups.select(
        F.lit(spec.name).alias("table"), F.lit(rule).alias("rule"),
        F.lit(", ".join(key)).alias("column"), key_text(spec, key, df).alias("key"),
        F.col("n_rows").cast("string").alias("value"),
    )


def unique_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of a (merged) table that break its key or a unique constraint.

    A null in a unique key conflicts with nothing; a partial key only looks at
    the rows its predicate selects.
    """
    keys = [(tuple(spec.primary_key), None)] if spec.primary_key else []
    keys += [(tuple(u.columns), u.predicate) for u in spec.unique]
    parts = [
        _as_violations(
            duplicate_keys(filter_rows(df, where).dropna("any", subset=list(key)), key),
            df, spec, key, "unique",
        )
        for key, where in keys
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def check_rows(df: DataFrame, spec: TableSpec, slc: SliceSpec | None = None,
               parse: bool = False) -> DataFrame:
    """Everything that must hold before a table's rows are merged."""
    return row_violations(df, spec, slc, parse).unionByName(key_violations(df, spec, slc))


def verify_tables(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], recorded: DataFrame
) -> DataFrame:
    """Row counts and contents against a record, then every row check.

    ``recorded`` holds ``table, rows, sha256``.  One row per problem.
    """
    from .digest import table_digests

    now = table_digests(tables, specs).select(
        "table", F.col("rows").alias("now_rows"), F.col("sha256").alias("now_sha")
    )
    both = recorded.select("table", "rows", "sha256").join(now, "table", "full_outer")
    counted = F.col("rows").eqNullSafe(F.col("now_rows"))
    against = both.select(
        "table",
        F.when(F.col("rows").isNull(), "not_recorded")
        .when(F.col("now_rows").isNull(), "missing")
        .when(~counted, "row_count")
        .when(F.col("sha256") != F.col("now_sha"), "content").alias("rule"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("key"),
        F.when(~counted, F.concat(
            F.coalesce(F.col("now_rows").cast("string"), F.lit("no")), F.lit(" rows, "),
            F.coalesce(F.col("rows").cast("string"), F.lit("none")), F.lit(" recorded"),
        )).alias("value"),
    ).filter(F.col("rule").isNotNull())
    return reduce(DataFrame.unionByName, [
        against, *[check_rows(df, specs[name]) for name, df in tables.items()]
    ])


def narrowing_impact(df: DataFrame, old: TableSpec, new: TableSpec) -> DataFrame:
    """Rows that a narrower column type would reject, per changed column.

    All columns are counted in one pass over the table.
    """
    changed = [
        (c, new.column(c.name)) for c in old.columns
        if c.name in df.columns and new.column(c.name) is not None
        and (c.label() != new.column(c.name).label()
             or (c.nullable and not new.column(c.name).nullable))
    ]
    aggs = []
    for was, now in changed:
        text = to_text(col(was.name), was, df.schema[was.name].dataType, exact=False)
        bad = F.coalesce(parse_failed(text, now), F.lit(False))
        if now.kind == "text" and now.max_len is not None:
            bad = bad | F.coalesce(F.char_length(text) > now.max_len, F.lit(False))
        if not now.nullable:
            bad = bad | col(was.name).isNull()
        aggs.append(F.count_if(bad).alias(was.name))
    if not aggs:
        return df.sparkSession.createDataFrame(
            [], "table string, column string, was string, now string, rows_affected bigint"
        )
    counted = df.agg(*aggs)
    return counted.select(F.explode(F.array(*[
        F.struct(
            F.lit(old.name).alias("table"), F.lit(was.name).alias("column"),
            F.lit(was.label()).alias("was"), F.lit(now.label()).alias("now"),
            col(was.name).cast("bigint").alias("rows_affected"),
        ) for was, now in changed
    ])).alias("r")).select("r.*")

