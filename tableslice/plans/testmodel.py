"""Declared columns, keys and references of the sample tables."""

from __future__ import annotations

from ..spec import (
    ColumnSpec, ForeignKey, SchemaSpec, TableSpec, double_col, int_col, text_col,
)


def _stamp(name):
    return ColumnSpec(name, "timestamp")


def _fk(column, table, ref):
    return ForeignKey((column,), table, (ref,))


SCHEMA = SchemaSpec.of(
    TableSpec("region", (int_col("r_regionkey", 32), text_col("r_name")), ("r_regionkey",)),
    TableSpec(
        "nation", (int_col("n_nationkey", 32), text_col("n_name"), int_col("n_regionkey", 32)),
        ("n_nationkey",), foreign_keys=(_fk("n_regionkey", "region", "r_regionkey"),),
    ),
    TableSpec(
        "customer",
        (int_col("c_custkey"), text_col("c_name"), int_col("c_nationkey", 32),
         double_col("c_acctbal"), text_col("c_mktsegment")),
        ("c_custkey",), foreign_keys=(_fk("c_nationkey", "nation", "n_nationkey"),),
    ),
    TableSpec(
        "supplier",
        (int_col("s_suppkey"), text_col("s_name"), int_col("s_nationkey", 32),
         double_col("s_acctbal")),
        ("s_suppkey",), foreign_keys=(_fk("s_nationkey", "nation", "n_nationkey"),),
    ),
    TableSpec(
        "part",
        (int_col("p_partkey"), text_col("p_name"), text_col("p_brand"), text_col("p_type"),
         int_col("p_size", 32), double_col("p_retailprice")),
        ("p_partkey",),
    ),
    TableSpec(
        "orders",
        (int_col("o_orderkey"), int_col("o_custkey"), text_col("o_orderstatus"),
         double_col("o_totalprice"), _stamp("o_orderdate"), text_col("o_orderpriority")),
        ("o_orderkey",), foreign_keys=(_fk("o_custkey", "customer", "c_custkey"),),
    ),
    # No key: (l_orderkey, l_linenumber) repeats in this data.
    TableSpec(
        "lineitem",
        (int_col("l_orderkey"), int_col("l_partkey"), int_col("l_suppkey"),
         int_col("l_linenumber", 32), double_col("l_quantity"), double_col("l_extendedprice"),
         double_col("l_discount"), double_col("l_tax"), text_col("l_returnflag"),
         text_col("l_linestatus"), _stamp("l_shipdate")),
        foreign_keys=(
            _fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"),
            _fk("l_suppkey", "supplier", "s_suppkey"),
        ),
    ),
    TableSpec(
        "events",
        (int_col("event_id"), _stamp("ts"), int_col("user_id"), text_col("event_type"),
         double_col("value"), ColumnSpec("props", "json")),
        ("event_id",), foreign_keys=(_fk("user_id", "customer", "c_custkey"),),
    ),
    TableSpec(
        "documents",
        (int_col("doc_id"), text_col("text"), text_col("lang"), text_col("source"),
         int_col("n_chars")),
        ("doc_id",),
    ),
    TableSpec(
        "labels", (int_col("doc_id"), int_col("quality", 32), int_col("toxic", 32)),
        ("doc_id",), foreign_keys=(_fk("doc_id", "documents", "doc_id"),),
    ),
    TableSpec("pages", (int_col("page_id"), text_col("url"), text_col("html")), ("page_id",)),
    TableSpec("benchmark", (int_col("item_id"), text_col("text")), ("item_id",)),
    TableSpec(
        "conversations",
        (int_col("conv_id"), int_col("turn"), text_col("role"), text_col("text")),
        ("conv_id", "turn"),
    ),
    TableSpec(
        "embeddings",
        (int_col("vec_id"), ColumnSpec("embedding", "array", of=ColumnSpec("item", "float", bits=32)),
         int_col("label", 32)),
        ("vec_id",),
    ),
)
