"""Foreign keys: checks, closures, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.checks import duplicate_keys, duplicate_rows
from ..operators.refs import ancestors, check_references, fk_keys, follow_parents
from ..spec import ForeignKey, SliceSpec
from .registry import Sample, query
from .testmodel import SCHEMA


@query("fk_keys_distinct", """
SELECT DISTINCT l_partkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS l_suppkey
FROM lineitem WHERE l_returnflag <> 'R'
""")
def _(t: Sample):
    rows = t.lineitem.withColumn("l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))
    return fk_keys(rows, ["l_partkey", "l_suppkey"])


def _cut(t: Sample):
    """Filtered tables whose references no longer all resolve."""
    return {
        "lineitem": t.lineitem,
        "orders": t.orders.filter("o_orderstatus <> 'P'"),
        "customer": t.customer.filter("c_acctbal >= 0"),
        "nation": t.nation.filter("n_regionkey <> 2"),
        "supplier": t.supplier,
    }


_CUT_SQL = """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT * FROM customer WHERE c_acctbal >= 0),
n AS (SELECT * FROM nation WHERE n_regionkey <> 2),
gone AS (
  SELECT DISTINCT 'lineitem' AS child, 'l_orderkey' AS columns, 'orders' AS parent,
    'o_orderkey' AS ref_columns, true AS parent_in_slice, l_orderkey AS k
  FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_orderkey = l_orderkey)
  UNION ALL SELECT DISTINCT 'lineitem', 'l_partkey', 'part', 'p_partkey', false, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'orders', 'o_custkey', 'customer', 'c_custkey', true, o_custkey
  FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey)
  UNION ALL SELECT DISTINCT 'customer', 'c_nationkey', 'nation', 'n_nationkey', true, c_nationkey
  FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n_nationkey = c_nationkey)
  UNION ALL SELECT DISTINCT 'supplier', 's_nationkey', 'nation', 'n_nationkey', true, s_nationkey
  FROM supplier WHERE NOT EXISTS (SELECT 1 FROM n WHERE n_nationkey = s_nationkey)
  UNION ALL SELECT DISTINCT 'nation', 'n_regionkey', 'region', 'r_regionkey', false, n_regionkey FROM n)
"""


@query("dangling_refs", _CUT_SQL + """
SELECT child, columns, parent, ref_columns, parent_in_slice, count(*) AS missing
FROM gone GROUP BY ALL
""")
def _(t: Sample):
    return check_references(_cut(t), SCHEMA, examples=0).drop("examples")


@query("dangling_examples", _CUT_SQL + """
SELECT child, columns, string_agg(v, '; ' ORDER BY v) AS examples FROM (
  SELECT child, columns, CAST(k AS VARCHAR) AS v,
    row_number() OVER (PARTITION BY child, columns ORDER BY CAST(k AS VARCHAR)) AS rn FROM gone)
WHERE rn <= 3 GROUP BY ALL
""")
def _(t: Sample):
    found = check_references(_cut(t), SCHEMA)
    return found.select("child", "columns", F.array_join("examples", "; ").alias("examples"))


def _urgent(t: Sample):
    slices = [
        SliceSpec("orders", where="o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
        SliceSpec("customer", where="c_mktsegment = 'BUILDING' AND c_acctbal > 9000"),
        SliceSpec("nation", where="false"),
        SliceSpec("region", where="false"),
    ]
    return follow_parents(t.some("orders", "customer", "nation", "region"), SCHEMA, slices)


_URGENT_SQL = """
WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
cb AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
cp AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)
       AND c_custkey NOT IN (SELECT c_custkey FROM cb)),
c AS (SELECT * FROM cb UNION ALL SELECT * FROM cp),
n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)),
r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
"""


@query("follow_parents_counts", _URGENT_SQL + """
SELECT 'orders' AS "table", count(*) AS rows, 0 AS pulled FROM o
UNION ALL SELECT 'customer', (SELECT count(*) FROM c), (SELECT count(*) FROM cp)
UNION ALL SELECT 'nation', count(*), count(*) FROM n
UNION ALL SELECT 'region', count(*), count(*) FROM r
""")
def _(t: Sample):
    return _urgent(t).report()


@query("follow_parents_rows", _URGENT_SQL + "SELECT * FROM c")
def _(t: Sample):
    return _urgent(t).tables["customer"]


@query("follow_parents_closed", _URGENT_SQL + """
SELECT 'orders' AS child, count(*) AS missing FROM o
WHERE o_custkey NOT IN (SELECT c_custkey FROM c) HAVING count(*) > 0
""")
def _(t: Sample):
    return check_references(_urgent(t).tables, SCHEMA, examples=0).select("child", "missing")


@query("follow_parents_limit", """
WITH c AS (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50),
e AS (SELECT * FROM events WHERE event_type = 'purchase' AND value > 100),
o AS (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 300),
cp AS (SELECT * FROM customer WHERE (c_custkey IN (SELECT user_id FROM e)
       OR c_custkey IN (SELECT o_custkey FROM o)) AND c_custkey NOT IN (SELECT c_custkey FROM c)),
n AS (SELECT * FROM nation WHERE n_nationkey IN
      (SELECT c_nationkey FROM c UNION SELECT c_nationkey FROM cp))
SELECT 'customer' AS "table", (SELECT count(*) FROM c) + (SELECT count(*) FROM cp) AS rows,
  (SELECT count(*) FROM cp) AS pulled
UNION ALL SELECT 'events', count(*), 0 FROM e
UNION ALL SELECT 'orders', count(*), 0 FROM o
UNION ALL SELECT 'nation', count(*), count(*) FROM n
UNION ALL SELECT 'region', count(*), count(*) FROM region
  WHERE r_regionkey IN (SELECT n_regionkey FROM n)
""")
def _(t: Sample):
    slices = [
        SliceSpec("customer", order_by=("c_acctbal",), limit=50),
        SliceSpec("events", where="event_type = 'purchase' AND value > 100"),
        SliceSpec("orders", order_by=("o_totalprice",), limit=300),
        SliceSpec("nation", where="1 = 0"),
    ]
    sources = t.some("customer", "events", "orders", "nation", "region")
    return follow_parents(sources, SCHEMA, slices, add_missing_parents=True).report()


@query("ancestor_closure", """
WITH RECURSIVE up(event_id) AS (
  SELECT event_id FROM events WHERE event_type = 'error' AND value > 100
  UNION SELECT event_id // 4 FROM up WHERE event_id > 0)
SELECT event_id FROM up
""")
def _(t: Sample):
    # Every event hangs on the one with a quarter of its number.
    linked = t.events.select(
        "event_id", "event_type", "value",
        F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 4)).alias("parent_id"),
    )
    start = linked.filter("event_type = 'error' AND value > 100")
    fk = ForeignKey(("parent_id",), "events", ("event_id",))
    return ancestors(start, linked, fk, ["event_id"], max_depth=64)


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY ALL HAVING count(*) > 1
""")
def _(t: Sample):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("duplicate_rows", """
SELECT l_orderkey, l_linenumber, min(i) AS first_row, max(i) AS second_row FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY i) AS rn FROM (
    SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      l_shipdate) AS i FROM lineitem))
WHERE rn <= 2 GROUP BY ALL HAVING count(*) = 2
""")
def _(t: Sample):
    return duplicate_rows(t.lineitem, SCHEMA.tables["lineitem"], ["l_orderkey", "l_linenumber"])
