"""The queries the library is checked and timed by, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TableSet, parquet_dir
from .testmodel import SCHEMA

Query = Callable[["Sample"], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


class Sample:
    """The sample tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = TableSet(spark, {"default": parquet_dir(folder)})

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMA.tables:
            return self.tables.read(name)
        raise AttributeError(name)

    def some(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.tables.read(n) for n in names}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what an independent engine must agree with."""
    def add(fn: Query) -> Query:
        _QUERIES[name] = (fn, sql)
        return fn

    return add


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from . import (  # noqa: F401
        constraint_queries, graph_queries, load_queries, object_queries, reference_queries, schema_queries,
        slice_queries, text_queries,
    )

    return dict(_QUERIES)


# --- SQL fragments -----------------------------------------------------------


def dbl(expr: str) -> str:
    """Canonical text of a double in SQL (plain magnitudes)."""
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def stamp(expr: str) -> str:
    """Canonical text of a timestamp without zone in SQL."""
    return (
        f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({expr}, '%f') = '000000' "
        f"THEN '' ELSE '.' || strftime({expr}, '%f') END)"
    )


def sized(expr: str) -> str:
    """One value of a row text in SQL: its length, a colon, itself."""
    return f"coalesce(CAST(length({expr}) AS VARCHAR) || ':' || {expr}, '\\N')"
