"""Schema drift: what the rows show against what was declared."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.checks import narrowing_impact
from ..operators.digest import schema_fingerprint
from ..operators.drift import (
    apply_policy, catalog, change_text, drift_counts, drop_accepted, observe_catalog, schema_drift,
)
from ..spec import (
    ColumnSpec, ForeignKey, SchemaSpec, SliceSpec, TableSpec, UniqueKey, double_col, int_col,
    text_col,
)
from .registry import Sample, query
from .testmodel import SCHEMA

_SEEN = ("customer", "orders", "part", "documents")


def _observed_sql(table: str, source: str | None = None) -> str:
    """``column, type, nullable`` as the rows show them, in SQL."""
    parts = []
    source = source or table
    for c in SCHEMA.tables[table].columns:
        if c.kind == "int":
            kind = (
                f"'int' || CASE WHEN min({c.name}) >= -128 AND max({c.name}) <= 127 THEN 8 "
                f"WHEN min({c.name}) >= -32768 AND max({c.name}) <= 32767 THEN 16 "
                f"WHEN min({c.name}) >= -2147483648 AND max({c.name}) <= 2147483647 THEN 32 ELSE 64 END"
            )
        elif c.kind == "text":
            kind = f"'varchar(' || max(length({c.name})) || ')'"
        else:
            kind = f"'{c.label()}'"
        parts.append(
            f"SELECT '{table}' AS \"table\", '{c.name}' AS \"column\", {kind} AS type, "
            f"count(*) > count({c.name}) AS nullable FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("observe_columns", " UNION ALL ".join(_observed_sql(n) for n in _SEEN))
def _(t: Sample):
    found = observe_catalog(t.some(*_SEEN), SCHEMA)
    return found.columns.select("table", "column", "type", "nullable")


_PART_NULLS = (
    "(SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN p_brand END AS p_brand, p_type, p_size, "
    "p_retailprice FROM part)"
)


def _recorded_part() -> TableSpec:
    """An older record of part: a shorter type, no nulls, a column since dropped."""
    return TableSpec(
        "part",
        (int_col("p_partkey", 8, nullable=False), text_col("p_name", 6, nullable=False),
         text_col("p_brand", nullable=False), text_col("p_type", 100), int_col("p_size", 64),
         ColumnSpec("p_retailprice", "decimal", precision=10, scale=2), text_col("p_comment")),
        ("p_partkey",), (UniqueKey(("p_name",)),),
        (ForeignKey(("p_size",), "sizes", ("id",)),),
    )


def _part_drift(t: Sample):
    seen = t.part.withColumn("p_brand", F.when(F.col("p_size") > 20, F.col("p_brand")))
    declared = replace(SCHEMA.tables["part"], unique=(UniqueKey(("p_brand",), "p_size > 3"),))
    live = observe_catalog({"part": seen}, SchemaSpec.of(declared))
    recorded = SchemaSpec.of(_recorded_part(), TableSpec("parts_old", (int_col("id"),), ("id",)))
    return schema_drift(catalog(t.spark, recorded), live)


_PART_DRIFT_SQL = f"""
WITH o AS ({_observed_sql('part', _PART_NULLS)}),
r("column", type, kind, size, nullable) AS (VALUES
  ('p_partkey', 'int8', 'int', 8, false), ('p_name', 'varchar(6)', 'text', 6, false),
  ('p_brand', 'text', 'text', NULL, false), ('p_type', 'varchar(100)', 'text', 100, true),
  ('p_size', 'int64', 'int', 64, true), ('p_retailprice', 'decimal(10,2)', 'decimal', NULL, true),
  ('p_comment', 'text', 'text', NULL, true)),
j AS (SELECT r."column", r.type AS was, o.type AS now, r.kind, r.size, r.nullable AS n0,
        o.nullable AS n1, CAST(nullif(regexp_extract(o.type, '([0-9]+)', 1), '') AS INT) AS now_size
      FROM r JOIN o ON r."column" = o."column"),
d AS (
  SELECT CASE WHEN kind = 'decimal' THEN 'breaking'
              WHEN kind = 'int' AND size <= now_size THEN 'benign'
              WHEN kind = 'int' THEN 'breaking'
              WHEN size <= now_size THEN 'benign' ELSE 'needs confirmation' END AS severity,
    'part' AS "table", "column", was || ' -> ' || now AS what FROM j WHERE was <> now
  UNION ALL SELECT 'breaking', 'part', "column", 'nullable -> NOT NULL' FROM j WHERE n0 AND NOT n1
  UNION ALL SELECT 'benign', 'part', "column", 'NOT NULL -> nullable' FROM j WHERE NOT n0 AND n1
  UNION ALL SELECT 'needs confirmation', 'part', r."column", 'column dropped (was ' || r.type || ')'
    FROM r WHERE r."column" NOT IN (SELECT "column" FROM o)
  UNION ALL SELECT 'needs confirmation', 'parts_old', NULL, 'table dropped'
  UNION ALL SELECT 'breaking', 'part', NULL, 'unique constraint dropped on (p_name)'
  UNION ALL SELECT 'benign', 'part', NULL, 'unique constraint added on (p_brand) where p_size > 3'
  UNION ALL SELECT 'breaking', 'part', NULL, 'foreign key on (p_size) dropped')
"""


@query("schema_drift", _PART_DRIFT_SQL + 'SELECT severity, "table", "column", what FROM d')
def _(t: Sample):
    return _part_drift(t).select("severity", "table", "column", "what")


@query("drift_counts", _PART_DRIFT_SQL + "SELECT severity, count(*) AS n FROM d GROUP BY severity")
def _(t: Sample):
    return drift_counts(_part_drift(t))


@query("drift_policy", _PART_DRIFT_SQL + """
SELECT "table", "column", what, CASE WHEN "table" = 'parts_old' THEN 'proceed'
  WHEN severity = 'benign' THEN 'proceed' ELSE 'abort' END AS action
FROM d WHERE NOT ("column" IS NOT DISTINCT FROM 'p_comment')
""")
def _(t: Sample):
    drift = _part_drift(t)
    accepted = (
        drift.filter("column = 'p_comment'")
        .select(F.col("table").alias("scope"), change_text().alias("change"))
    )
    policy = [SliceSpec("part", on_drift="abort"), SliceSpec("parts_old", on_drift="ignore")]
    return apply_policy(drop_accepted(drift, accepted), policy).select(
        "table", "column", "what", "action")


@query("schema_fingerprint", f"""
SELECT substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS fingerprint FROM (
  SELECT 'col ' || "table" || ' ' || "column" || ' ' || type || ' ' || CAST(nullable AS VARCHAR)
    || ' false false' AS line FROM ({' UNION ALL '.join(_observed_sql(n) for n in _SEEN)}))
""")
def _(t: Sample):
    return schema_fingerprint(observe_catalog(t.some(*_SEEN), SCHEMA).columns)


@query("narrowing_impact", """
SELECT 'lineitem' AS "table", 'l_partkey' AS "column", 'int64' AS was, 'int8' AS now,
  count(*) FILTER (l_partkey > 127) AS rows_affected FROM lineitem
UNION ALL SELECT 'lineitem', 'l_quantity', 'float64', 'int16',
  count(*) FILTER (l_quantity <> floor(l_quantity)) FROM lineitem
UNION ALL SELECT 'lineitem', 'l_linestatus', 'text', 'bool',
  count(*) FILTER (l_linestatus NOT IN ('t', 'f')) FROM lineitem
UNION ALL SELECT 'documents', 'text', 'text', 'varchar(2000)',
  count(*) FILTER (length(text) > 2000) FROM documents
UNION ALL SELECT 'documents', 'source', 'text', 'varchar(4)',
  count(*) FILTER (length(source) > 4) FROM documents
""")
def _(t: Sample):
    line, docs = SCHEMA.tables["lineitem"], SCHEMA.tables["documents"]
    return narrowing_impact(t.lineitem, line, TableSpec("lineitem", (
        int_col("l_partkey", 8), int_col("l_quantity", 16), ColumnSpec("l_linestatus", "bool"),
        double_col("l_tax"),
    ))).unionByName(narrowing_impact(t.documents, docs, TableSpec("documents", (
        text_col("text", 2000), text_col("source", 4), int_col("n_chars")))))


def _labels(t: Sample, column: str) -> tuple[str, ...]:
    """The labels the rows of orders show, in order."""
    return tuple(r[0] for r in t.orders.select(column).distinct().orderBy(column).collect())


def _evolved(t: Sample) -> tuple[SchemaSpec, SchemaSpec]:
    """A record of orders and customers, and what they became; labels, lengths and nulls are read from the rows."""
    priorities, states = _labels(t, "o_orderpriority"), _labels(t, "o_orderstatus")
    longest = t.customer.agg(F.max(F.length("c_name"))).first()[0]
    full = t.orders.filter("o_totalprice IS NULL").isEmpty()
    key = [int_col("o_orderkey", nullable=False), int_col("o_custkey")]
    was = SchemaSpec.of(
        TableSpec("orders", (
            *key, ColumnSpec("o_orderpriority", "enum", type_name="priority"), ColumnSpec("o_orderstatus", "enum", type_name="status"),
            double_col("o_totalprice"), text_col("o_flag"), text_col("o_same")),
            ("o_orderkey",), (UniqueKey(("o_flag",)),),
            (ForeignKey(("o_custkey",), "customer", ("c_custkey",)), ForeignKey(("o_same",), "customer", ("c_name",)))),
        TableSpec("customer", (int_col("c_custkey"), text_col("c_name", longest), ColumnSpec("c_segment", "enum", type_name="segment")),
                  ("c_custkey",)),
        TableSpec("archive", (int_col("id"),), ("id",)),
        enums={"priority": (priorities[0], "0-NEVER"), "status": states[::-1], "segment": ("x", "y")})
    now = SchemaSpec.of(
        TableSpec("orders", (
            text_col("o_same"), text_col("o_flag", generated=True), text_col("o_remark"), text_col("o_must", nullable=False),
            double_col("o_totalprice", nullable=not full, has_default=True), ColumnSpec("o_orderstatus", "enum", type_name="state"),
            ColumnSpec("o_orderpriority", "enum", type_name="priority"), *key[::-1]),
            ("o_orderkey", "o_custkey"), (UniqueKey(("o_flag",)),),
            (ForeignKey(("o_custkey",), "clients", ("id",)), ForeignKey(("o_same",), "customer", ("c_name",)),
             ForeignKey(("o_remark",), "clients", ("id",)))),
        TableSpec("customer", (text_col("c_segment"), text_col("c_name", longest + 1), int_col("c_custkey")), ("c_custkey",)),
        TableSpec("clients", (int_col("id"),), ("id",)),
        enums={"priority": priorities, "state": states})
    return was, now


_EVOLVED_SQL = """
WITH p AS (SELECT DISTINCT o_orderpriority AS label FROM orders),
n AS (SELECT max(length(c_name)) AS longest FROM customer),
d(severity, "table", "column", what) AS (
  SELECT 'benign', 'clients', NULL, 'table added'
  UNION ALL SELECT 'benign', 'orders', 'o_remark', 'column added (text, nullable)'
  UNION ALL SELECT 'breaking', 'orders', 'o_must', 'column added (text, NOT NULL with no default)'
  UNION ALL SELECT 'breaking', 'orders', NULL, 'primary key (o_orderkey) -> (o_orderkey, o_custkey)'
  UNION ALL SELECT 'benign', 'orders', 'o_totalprice', 'nullable -> NOT NULL' WHERE (SELECT count(*) = count(o_totalprice) FROM orders)
  UNION ALL SELECT 'breaking', 'orders', 'o_flag', 'column became generated'
  UNION ALL SELECT 'breaking', 'orders', NULL, 'foreign key on (o_custkey) retargeted: customer(c_custkey) -> clients(id)'
  UNION ALL SELECT 'breaking', 'orders', NULL, 'foreign key added on (o_remark) -> clients(id)'
  UNION ALL SELECT 'benign', 'customer', 'c_name', 'varchar(' || longest || ') -> varchar(' || (longest + 1) || ')' FROM n
  UNION ALL SELECT 'benign', 'customer', 'c_segment', 'enum segment -> text'
  UNION ALL SELECT 'breaking', 'orders', 'o_custkey', 'nullable -> NOT NULL'  -- part of the key now
  UNION ALL SELECT 'breaking', 'orders', NULL, 'enum priority: label "0-NEVER" removed'
  UNION ALL SELECT 'benign', 'orders', NULL, 'enum priority: label "' || label || '" added' FROM p
    WHERE label > (SELECT min(label) FROM p))
SELECT false AS creatable, * FROM d
UNION ALL SELECT false, 'needs confirmation', 'archive', NULL, 'table dropped'
UNION ALL SELECT false, 'breaking', 'customer', NULL, 'enum type segment dropped'
UNION ALL SELECT true, * FROM d
UNION ALL SELECT true, 'benign', 'archive', NULL, 'not in the target yet'
"""


@query("drift_rules", _EVOLVED_SQL)
def _(t: Sample):
    """Tables, keys, references, labels and columns that change; what is only renamed or moved says nothing."""
    was, now = _evolved(t)
    def lines(creatable):
        return schema_drift(catalog(t.spark, was), catalog(t.spark, now), creatable).select(
            F.lit(creatable).alias("creatable"), "severity", "table", "column", "what")
    return lines(False).unionByName(lines(True))
