"""Cutting single tables, counts, and digests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.canonical import canonicalize
from ..operators.counts import next_identity, row_counts, status, totals
from ..operators.digest import (
    digest_of_digests, row_digests, table_digest, table_digests,
)
from ..operators.documents import filter_document
from ..operators.merkle import differing_ranges, digest_tree, ordered_digest, range_diff, write_ranges
from ..operators.slicing import align_to_spec, cut_table, key_filter
from ..session import ensure_checkpoint_dir, scratch
from ..spec import SliceSpec, align_column_order, spec_from_schema
from .registry import Sample, dbl, query, sized, stamp
from .testmodel import SCHEMA


@query("slice_project_filter", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT'
""")
def _(t: Sample):
    slc = SliceSpec(
        "orders", where="o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT'",
        columns=("o_totalprice", "o_orderkey", "o_custkey"),
    )
    return cut_table(t.orders, SCHEMA.tables["orders"], slc)


@query("slice_exclude_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R'
""")
def _(t: Sample):
    slc = SliceSpec(
        "lineitem", where="l_returnflag = 'R'", load="insert",
        exclude_columns=("l_discount", "l_tax", "l_shipdate"),
    )
    return cut_table(t.lineitem, SCHEMA.tables["lineitem"], slc)


@query("slice_topk_total_order", """
SELECT * FROM customer
ORDER BY c_mktsegment NULLS LAST, c_nationkey NULLS LAST, c_custkey LIMIT 100
""")
def _(t: Sample):
    slc = SliceSpec("customer", order_by=("c_mktsegment", "c_nationkey"), limit=100)
    return cut_table(t.customer, SCHEMA.tables["customer"], slc)


@query("slice_topk_nulls_last", """
SELECT doc_id, n_chars, nullif(lang, 'en') AS lang FROM documents
ORDER BY nullif(lang, 'en') NULLS LAST, n_chars NULLS LAST, doc_id LIMIT 500
""")
def _(t: Sample):
    docs = t.documents.select("doc_id", "n_chars", F.nullif("lang", F.lit("en")).alias("lang"))
    spec = spec_from_schema("documents", docs.schema, ("doc_id",))
    return cut_table(docs, spec, SliceSpec("documents", order_by=("lang", "n_chars"), limit=500))


@query("key_filter_semi", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def _(t: Sample):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    return key_filter(rows, urgent, [("l_orderkey", "o_orderkey")])


@query("key_filter_composite", """
SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type) IN
  (SELECT user_id, event_type FROM events WHERE value > 200 AND user_id <> 8)
""")
def _(t: Sample):
    keys = t.events.filter("value > 200").withColumn("user_id", F.nullif("user_id", F.lit(8)))
    rows = t.events.select("event_id", "user_id", "event_type")
    return key_filter(rows, keys, [("user_id", "user_id"), ("event_type", "event_type")])


@query("filter_document", """
SELECT event_id, user_id, event_type, value FROM events
WHERE event_type <> 'view' AND (value >= 50 OR event_type IN ('error', 'signup'))
  AND NOT (value > 300)
""")
def _(t: Sample):
    rule = {
        "event_type": {"$ne": "view"},
        "$or": [{"value": {"$gte": 50}}, {"event_type": {"$in": ["error", "signup"]}}],
        "value": {"$not": {"$gt": 300}},
    }
    return t.events.filter(filter_document(rule)).select("event_id", "user_id", "event_type", "value")


@query("align_to_spec", """
SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus,
       CAST(NULL AS DOUBLE) AS o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate, o_orderpriority
FROM orders
""")
def _(t: Sample):
    seed = t.orders.select("o_orderpriority", "o_orderkey", "o_custkey")
    return align_to_spec(seed, SCHEMA.tables["orders"])


@query("canonical_column_order", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, p_partkey + 1 AS p_next FROM part
""")
def _(t: Sample):
    live = t.part.select(
        "p_size", "p_name", (F.col("p_partkey") + 1).alias("p_next"), "p_retailprice", "p_type",
        "p_brand", "p_partkey",
    )
    ordered = align_column_order(SCHEMA.tables["part"], spec_from_schema("part", live.schema))
    return live.select(*ordered.column_names)


_COUNTED = list(SCHEMA.tables)


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in _COUNTED))
def _(t: Sample):
    return row_counts(t.some(*_COUNTED))


@query("count_totals", "SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows FROM ("
       + " UNION ALL ".join(f"SELECT count(*) AS n FROM {n}" for n in _COUNTED) + ")")
def _(t: Sample):
    return totals(row_counts(t.some(*_COUNTED)))


@query("status_report", """
WITH r AS (
  SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'customer', count(*) FROM customer
  UNION ALL SELECT 'region', count(*) FROM region),
l AS (
  SELECT 'orders' AS "table", count(*) AS n FROM orders
  UNION ALL SELECT 'customer', count(*) FROM customer
  UNION ALL SELECT 'nation', count(*) FROM nation)
SELECT coalesce(r."table", l."table") AS "table", r.n AS recorded, l.n AS live,
  CASE WHEN r.n = l.n THEN 'in sync'
       WHEN r.n IS NOT NULL AND l.n IS NOT NULL THEN 'seeded ' || r.n || ', live ' || l.n
       WHEN l.n IS NOT NULL THEN 'not exported, live ' || l.n
       ELSE 'seeded ' || r.n || ', live unknown' END AS note
FROM r FULL OUTER JOIN l ON r."table" = l."table"
""")
def _(t: Sample):
    recorded = row_counts({
        "orders": t.orders.filter("o_orderstatus <> 'P'"), "customer": t.customer,
        "region": t.region,
    })
    return status(recorded, row_counts(t.some("orders", "customer", "nation")))


@query("next_identity", """
SELECT 'orders' AS "table", coalesce(max(o_orderkey), 0) + 1 AS next FROM orders
UNION ALL SELECT 'events', coalesce(max(event_id), 0) + 1 FROM events
UNION ALL SELECT 'none', 1
""")
def _(t: Sample):
    def of(name, df, column):
        return next_identity(df, column).select(F.lit(name).alias("table"), "next")

    return (
        of("orders", t.orders, "o_orderkey").unionByName(of("events", t.events, "event_id"))
        .unionByName(of("none", t.orders.filter("o_totalprice < 0"), "o_orderkey"))
    )


_ORDER_TEXT = "concat_ws('|', " + ", ".join(sized(e) for e in (
    "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
    dbl("o_totalprice"), stamp("o_orderdate"), "o_orderpriority")) + ")"
_CUSTOMER_TEXT = "concat_ws('|', " + ", ".join(sized(e) for e in (
    "CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)", dbl("c_acctbal"),
    "c_mktsegment")) + ")"
_SUPPLIER_TEXT = "concat_ws('|', " + ", ".join(sized(e) for e in (
    "CAST(s_suppkey AS VARCHAR)", "s_name", "CAST(s_nationkey AS VARCHAR)", dbl("s_acctbal"))) + ")"


def _digest_sql(text: str, table: str) -> str:
    sums = ", ".join(
        f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)"
        for i in range(8)
    )
    return (
        f"SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums})) AS sha256 "
        f"FROM (SELECT sha256({text}) AS h FROM {table})"
    )


_DIGESTS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", rows, sha256 FROM ({_digest_sql(x, n)})"
    for n, x in (("orders", _ORDER_TEXT), ("customer", _CUSTOMER_TEXT), ("supplier", _SUPPLIER_TEXT))
)


@query("table_digest_rows", f"SELECT o_orderkey, sha256({_ORDER_TEXT}) AS row_sha256 FROM orders")
def _(t: Sample):
    return row_digests(t.orders, SCHEMA.tables["orders"], keep=["o_orderkey"])


@query("table_digest", _digest_sql(_ORDER_TEXT, "orders"))
def _(t: Sample):
    return table_digest(t.orders, SCHEMA.tables["orders"])


@query("table_digests", _DIGESTS_SQL)
def _(t: Sample):
    return table_digests(t.some("orders", "customer", "supplier"), SCHEMA.tables)


@query("digest_of_digests", f"""
SELECT sha256(string_agg("table" || chr(0) || sha256 || chr(0), '' ORDER BY "table")) AS sha256
FROM ({_DIGESTS_SQL})
""")
def _(t: Sample):
    return digest_of_digests(table_digests(t.some("orders", "customer", "supplier"), SCHEMA.tables))


@query("canonical_text", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
  CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  {dbl('l_quantity')} AS l_quantity, {dbl('l_extendedprice')} AS l_extendedprice,
  {dbl('l_discount')} AS l_discount, {dbl('l_tax')} AS l_tax, l_returnflag, l_linestatus,
  {stamp('l_shipdate')} AS l_shipdate FROM lineitem
""")
def _(t: Sample):
    return canonicalize(t.lineitem, SCHEMA.tables["lineitem"])


@query("canonical_text_events", f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, {stamp('ts')} AS ts,
  CAST(user_id AS VARCHAR) AS user_id, event_type, {dbl('value')} AS value, props FROM events
""")
def _(t: Sample):
    return canonicalize(t.events, SCHEMA.tables["events"])


_SPARSE_SQL = f"""
orders_text AS (SELECT *, {_ORDER_TEXT} AS txt FROM orders),
sparse AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 997 = 3 THEN o_totalprice + 1 ELSE o_totalprice END
    AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1009 <> 5
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
  WHERE o_orderkey % 1013 = 7)"""


def _sparse(t: Sample):
    """A copy of orders in which few rows are gone, dearer or new."""
    key = F.col("o_orderkey")
    kept = t.orders.filter(key % 1009 != 5).withColumn(
        "o_totalprice", F.when(key % 997 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.unionByName(t.orders.filter(key % 1013 == 7).withColumn("o_orderkey", -key - 1))


@query("table_digest_ordered", f"""
WITH h AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, sha256({_ORDER_TEXT}) AS h FROM orders),
nodes AS (SELECT i // 1024 AS node, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS n FROM h GROUP BY i // 1024)
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY node)) AS sha256 FROM nodes
""")
def _(t: Sample):
    """The sample has between 1,025 and a million orders: two levels."""
    return ordered_digest(t.orders, SCHEMA.tables["orders"])


_RANGE = "substr(sha256(length(CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR)), 1, 3)"


@query("differing_ranges", f"""
WITH {_SPARSE_SQL},
changed AS (SELECT {_RANGE} AS range FROM (
  (SELECT * FROM sparse EXCEPT SELECT * FROM orders) UNION ALL (SELECT * FROM orders EXCEPT SELECT * FROM sparse))),
a AS (SELECT {_RANGE} AS range, count(*) AS rows FROM sparse GROUP BY 1),
b AS (SELECT {_RANGE} AS range, count(*) AS rows FROM orders GROUP BY 1)
SELECT range, coalesce(a.rows, 0) AS rows, coalesce(b.rows, 0) AS other_rows
FROM (SELECT DISTINCT range FROM changed) LEFT JOIN a USING (range) LEFT JOIN b USING (range)
""")
def _(t: Sample):
    spec = SCHEMA.tables["orders"]
    return differing_ranges(digest_tree(_sparse(t), spec), digest_tree(t.orders, spec))


@query("ranged_diff", f"""
WITH {_SPARSE_SQL}
SELECT CAST(coalesce(s.o_orderkey, o.o_orderkey) AS VARCHAR) AS key,
  CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN s.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM sparse s FULL JOIN orders o ON s.o_orderkey = o.o_orderkey
WHERE s.o_orderkey IS NULL OR o.o_orderkey IS NULL OR s.o_totalprice <> o.o_totalprice
""")
def _(t: Sample):
    spec, folder = SCHEMA.tables["orders"], scratch(t.spark, f"{ensure_checkpoint_dir(t.spark)}/ranges-{uuid.uuid4().hex}")
    write_ranges(_sparse(t), f"{folder}/seed", spec, digits=2)
    write_ranges(t.orders, f"{folder}/live", spec, digits=2)
    found = range_diff(t.spark, f"{folder}/seed", f"{folder}/live", spec, SliceSpec("orders", load="truncate_first"), digits=2)
    return found.filter("change <> 'unchanged'").select(F.array_join("key", ", ").alias("key"), "change")
