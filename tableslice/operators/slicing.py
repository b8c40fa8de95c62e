"""Cutting one table: columns, predicate, total order, limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import to_text
from ..spec import ColumnSpec, SliceSpec, TableSpec, selected_columns


#: Rows of a limited slice that one task may hold.
TOP_K = 100_000


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def select_columns(df: DataFrame, spec: TableSpec, slc: SliceSpec) -> DataFrame:
    """The slice's columns in the table's order, whatever order was asked for."""
    return df.select(*[col(c.name) for c in selected_columns(spec, slc)])


def filter_rows(df: DataFrame, where: str | None) -> DataFrame:
    """A SQL predicate; parenthesised so that an OR in it stays its own."""
    return df if where is None else df.filter(F.expr(f"({where})"))


def order_columns(
    spec: TableSpec, columns: Sequence[ColumnSpec], slc: SliceSpec
) -> list[str]:
    """Asked-for columns, then the key, then every other orderable column."""
    for name in slc.order_by:
        spec.require(name, "order_by")
    held = {c.name for c in columns}
    names = [*slc.order_by, *(k for k in spec.primary_key if k in held)]
    names += [c.name for c in columns if c.orderable]
    return list(dict.fromkeys(names))


def total_order(spec: TableSpec, slc: SliceSpec | None = None) -> list[Column]:
    """Sort terms under which no two different rows tie.

    Text sorts by bytes (Spark's default collation) and nulls come last.
    Columns with no order of their own break the remaining ties by their
    canonical text; where the table has a key there are none to break.
    """
    slc = slc or SliceSpec(spec.name)
    columns = selected_columns(spec, slc)
    terms = [col(n).asc_nulls_last() for n in order_columns(spec, columns, slc)]
    if not spec.primary_key:
        terms += [
            to_text(col(c.name), c).asc_nulls_last()
            for c in columns if not c.orderable and c.name not in slc.order_by
        ]
    return terms


def cut_table(df: DataFrame, spec: TableSpec, slc: SliceSpec, ordered: bool = False) -> DataFrame:
    """The slice of one table.

    A limit takes the first rows of the total order: up to ``TOP_K`` of them by
    a top-k, whose rows meet in one task, more of them by row number after a
    distributed sort.
    Without one the rows are only sorted when ``ordered`` asks for it: joins
    and merges further on do not need the order, file writers do.
    """
    terms = total_order(spec, slc)
    rows = filter_rows(df, slc.where)
    if slc.limit is not None:
        rows = _first_rows(rows, spec, terms, slc.limit)
    elif ordered:
        rows = rows.orderBy(*terms)
    return select_columns(rows, spec, slc)


def _first_rows(rows: DataFrame, spec: TableSpec, terms: Sequence[Column], n: int) -> DataFrame:
    if n <= TOP_K:
        return rows.orderBy(*terms).limit(n)
    from .rowindex import row_index  # which needs ``col`` from here

    unique = bool(spec.primary_key) and set(spec.primary_key) <= set(rows.columns)
    return row_index(rows, terms, "__n", unique).filter(F.col("__n") <= n).drop("__n")


def key_filter(df: DataFrame, keys: DataFrame, on: Sequence[tuple[str, str]],
               distinct: bool = True) -> DataFrame:
    """Rows whose key tuple is among ``keys``; a null in a tuple matches nothing.

    ``on`` pairs a column of ``df`` with one of ``keys``.  The key side is made
    distinct first, so each key crosses the network once (``distinct=False`` where
    it is known to be).  Spark broadcasts it
    when it is measured to be small; beyond that the rows are shuffled, and a
    hot key's rows are split by the skew handling semi joins have.
    """
    right = keys.select(*[col(k).alias(f"__k{i}") for i, (_, k) in enumerate(on)])
    if distinct:
        right = right.filter(reduce(Column.__and__, [col(c).isNotNull() for c in right.columns]))
        right = right.distinct()
    cond = [col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(on)]
    return df.join(right, cond, "left_semi")


def align_to_spec(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns in the spec's order; absent ones NULL, unknown ones an error."""
    for name in df.columns:
        spec.require(name, "columns")
    return df.select(*[
        (col(c.name) if c.name in df.columns else F.lit(None)).cast(c.spark_type()).alias(c.name)
        for c in spec.columns
    ])
