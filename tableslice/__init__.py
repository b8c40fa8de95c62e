"""Referentially complete slices of related tables, as Spark DataFrame jobs."""

from .spec import (
    ColumnSpec, ForeignKey, SchemaSpec, SliceSpec, TableSpec, UniqueKey,
)

__all__ = ["ColumnSpec", "ForeignKey", "SchemaSpec", "SliceSpec", "TableSpec", "UniqueKey"]
