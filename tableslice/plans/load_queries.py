"""Row checks, merges and diffs."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import parse_failed
from ..operators.checks import check_rows, unique_violations, verify_tables
from ..operators.counts import row_counts
from ..operators.diff import diff_counts, removed_keys, row_diff
from ..operators.digest import table_digests
from ..operators.merge import (
    conflicts, merge_documents, merge_insert, merge_result, merge_skip_existing, merge_tables,
    merge_truncate_first, merge_upsert,
)
from ..operators.refs import check_references
from ..session import ensure_checkpoint_dir, scratch
from ..sources.commit import committed
from ..spec import ColumnSpec, SchemaSpec, SliceSpec, TableSpec, UniqueKey, int_col, text_col
from .load import load, load_plan
from .registry import Sample, dbl, query
from .testmodel import SCHEMA

ORDERS = SCHEMA.tables["orders"]


def order_seed(t: Sample) -> DataFrame:
    """A changed copy of orders: low-priority rows dropped, finished ones dearer,
    urgent ones also copied to new (negative) keys."""
    kept = t.orders.filter("o_orderpriority <> '5-LOW'").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")),
    )
    fresh = t.orders.filter("o_orderpriority = '1-URGENT'").withColumn(
        "o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(fresh)


SEED_SQL = """
seed AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')
"""


@query("merge_upsert", f"""WITH {SEED_SQL}
SELECT * FROM seed
UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seed)
""")
def _(t: Sample):
    return merge_upsert(t.orders, order_seed(t), ORDERS)


@query("merge_upsert_some_columns", f"""WITH {SEED_SQL}
SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, o.o_custkey, o.o_orderstatus,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
  o.o_orderdate, o.o_orderpriority
FROM orders o FULL OUTER JOIN seed s ON o.o_orderkey = s.o_orderkey
""")
def _(t: Sample):
    return merge_upsert(t.orders, order_seed(t).select("o_orderkey", "o_totalprice"), ORDERS)


@query("merge_skip_existing", f"""WITH {SEED_SQL}
SELECT * FROM orders
UNION ALL SELECT * FROM seed WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def _(t: Sample):
    return merge_skip_existing(t.orders, order_seed(t), ORDERS)


@query("merge_skip_duplicates", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events
  WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 150))
WHERE rn = 1
UNION ALL SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events
  WHERE value > 150) WHERE rn = 1
""")
def _(t: Sample):
    spec = TableSpec(
        "latest",
        (int_col("event_id"), int_col("user_id"), text_col("event_type"),
         ColumnSpec("value", "float", bits=64)),
        unique=(UniqueKey(("user_id", "event_type")),),
    )
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    empty = rows.limit(0)
    target = merge_skip_existing(empty, rows.filter("value > 150"), spec)
    return merge_skip_existing(target, rows, spec)


@query("merge_skip_two_keys", """
SELECT vec_id, a, b FROM (SELECT vec_id, label AS a, vec_id AS b,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1
""")
def _(t: Sample):
    spec = TableSpec(
        "picked", (int_col("vec_id"), int_col("a", 32), int_col("b")),
        ("vec_id",), unique=(UniqueKey(("a",)), UniqueKey(("b",))),
    )
    rows = t.embeddings.select("vec_id", F.col("label").alias("a"), F.col("vec_id").alias("b"))
    return merge_skip_existing(rows.limit(0), rows, spec)


@query("merge_skip_chain", """
SELECT c_custkey, c_custkey // 2 AS a, (c_custkey + 1) // 2 AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY island ORDER BY c_custkey) AS place FROM (
    SELECT c_custkey, c_custkey - row_number() OVER (ORDER BY c_custkey) AS island FROM customer WHERE c_acctbal > -800))
WHERE place % 2 = 1
""")
def _(t: Sample):
    """Each row shares one value with the row before it and another with the row after."""
    spec = TableSpec("pairs", (int_col("c_custkey"), int_col("a"), int_col("b")), ("c_custkey",),
                     unique=(UniqueKey(("a",)), UniqueKey(("b",))))
    key = F.col("c_custkey")
    rows = t.customer.filter("c_acctbal > -800").select(
        key, F.floor(key / 2).cast("long").alias("a"), F.floor((key + 1) / 2).cast("long").alias("b"))
    return merge_skip_existing(rows.limit(0), rows, spec)


@query("merge_insert", """
SELECT * FROM orders
UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority FROM orders
""")
def _(t: Sample):
    seed = t.orders.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return merge_insert(t.orders, seed, ORDERS)


@query("insert_conflicts", f"""WITH {SEED_SQL}
SELECT 'orders' AS "table", '(o_orderkey)' AS "constraint", CAST(o_orderkey AS VARCHAR) AS key,
  CAST(1 AS BIGINT) AS seed_rows, true AS in_target
FROM seed WHERE o_orderkey IN (SELECT o_orderkey FROM orders)
""")
def _(t: Sample):
    return conflicts(t.orders, order_seed(t), ORDERS)


@query("merge_truncate_first", f"WITH {SEED_SQL} SELECT * FROM seed")
def _(t: Sample):
    return merge_truncate_first(t.orders, order_seed(t), ORDERS)


@query("merge_results", f"""WITH {SEED_SQL},
fresh AS (SELECT count(*) AS n FROM seed WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT 'orders' AS "table", 'upsert' AS mode, count(*) AS rows, count(*) AS affected, 0 AS deleted FROM seed
UNION ALL SELECT 'orders', 'skip_existing', (SELECT count(*) FROM seed), n, 0 FROM fresh
UNION ALL SELECT 'orders', 'truncate_first', count(*), count(*), (SELECT count(*) FROM orders) FROM seed
""")
def _(t: Sample):
    parts = [
        merge_result(t.orders, order_seed(t), ORDERS, SliceSpec("orders", load=mode))
        for mode in ("upsert", "skip_existing", "truncate_first")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PARTIAL = TableSpec(
    "docs",
    (int_col("event_id"), int_col("user_id"), text_col("event_type"),
     ColumnSpec("value", "float", bits=64)),
    unique=(UniqueKey(("user_id", "event_type"), "value > 150"),),
)


@query("merge_partial_key", """
WITH base AS (SELECT user_id, event_type, min(event_id) AS event_id, max(value) AS value
              FROM events GROUP BY ALL),
seed AS (SELECT user_id, event_type, event_id, value + 10 AS value FROM base
         WHERE event_type <> 'view')
SELECT user_id, event_type, event_id, value FROM base WHERE NOT (value > 150)
UNION ALL SELECT user_id, event_type, event_id, value FROM seed WHERE NOT (value > 150)
UNION ALL SELECT s.user_id, s.event_type, s.event_id, s.value FROM seed s WHERE s.value > 150
UNION ALL SELECT b.user_id, b.event_type, b.event_id, b.value FROM base b WHERE b.value > 150
  AND NOT EXISTS (SELECT 1 FROM seed s WHERE s.value > 150 AND s.user_id = b.user_id
                  AND s.event_type = b.event_type)
""")
def _(t: Sample):
    base = t.events.groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("event_id"), F.max("value").alias("value")
    ).select("event_id", "user_id", "event_type", "value")
    seed = base.filter("event_type <> 'view'").withColumn("value", F.col("value") + 10)
    return merge_upsert(base, seed, _PARTIAL)


@query("merge_null_keys", """
WITH base AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS k,
                     o_custkey, o_totalprice FROM orders),
seed AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey END AS k,
                o_custkey, o_totalprice + 5 AS o_totalprice FROM orders)
SELECT * FROM seed
UNION ALL SELECT * FROM base WHERE k IS NULL OR k NOT IN (SELECT k FROM seed WHERE k IS NOT NULL)
""")
def _(t: Sample):
    spec = TableSpec(
        "nullable", (int_col("k"), int_col("o_custkey"), ColumnSpec("o_totalprice", "float", bits=64)),
        unique=(UniqueKey(("k",)),),
    )

    def keyed(keep, price):
        return t.orders.select(
            F.when(F.expr(keep), F.col("o_orderkey")).alias("k"), "o_custkey",
            price.alias("o_totalprice"),
        )

    base = keyed("o_orderstatus <> 'P'", F.col("o_totalprice"))
    seed = keyed("o_orderpriority <> '5-LOW'", F.col("o_totalprice") + 5)
    return merge_upsert(base, seed, spec)


@query("merge_documents_replace", """
SELECT event_id AS _id, event_type AS kind, NULL AS score FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, value FROM events WHERE event_type = 'error'
""")
def _(t: Sample):
    target = t.events.select(
        F.col("event_id").alias("_id"), F.col("event_type").alias("kind"),
        F.lit(None).cast("double").alias("score"))
    seed = t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("_id"), F.col("value").alias("score"))
    return merge_documents(target, seed, "replace")


@query("merge_documents_set_on_insert", """
SELECT event_id AS _id, event_type AS kind FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'new' FROM events WHERE event_type = 'error'
""")
def _(t: Sample):
    docs = t.events.select(F.col("event_id").alias("_id"), F.col("event_type").alias("kind"))
    seed = docs.withColumn("kind", F.lit("new"))
    return merge_documents(docs.filter("kind <> 'error'"), seed, "set_on_insert")


def _diff_sql(select: str, tail: str = "") -> str:
    return f"""WITH {SEED_SQL},
pairs AS (SELECT s.o_orderkey AS sk, l.o_orderkey AS lk, s.o_totalprice AS sp, l.o_totalprice AS lp
  FROM seed s FULL OUTER JOIN orders l ON s.o_orderkey = l.o_orderkey),
d AS (SELECT CAST(coalesce(sk, lk) AS VARCHAR) AS key,
  CASE WHEN sk IS NULL THEN 'removed' WHEN lk IS NULL THEN 'added'
       WHEN sp <> lp THEN 'updated' ELSE 'unchanged' END AS change,
  CASE WHEN sk IS NOT NULL AND lk IS NOT NULL AND sp <> lp
       THEN 'o_totalprice: ' || {dbl('lp')} || ' -> ' || {dbl('sp')} END AS changes FROM pairs)
SELECT {select} FROM d {tail}"""


def _diff(t: Sample) -> DataFrame:
    return row_diff(order_seed(t), t.orders, ORDERS, SliceSpec("orders", load="truncate_first"))


@query("row_diff", _diff_sql("key, change, changes"))
def _(t: Sample):
    text = F.array_join(F.transform("changes", lambda c: F.concat(
        c["column"], F.lit(": "), c["before"], F.lit(" -> "), c["after"])), "; ")
    return _diff(t).select(
        F.array_join("key", ", ").alias("key"), "change", F.nullif(text, F.lit("")).alias("changes"))


@query("diff_counts", _diff_sql(
    "'orders' AS \"table\", count(*) FILTER (change = 'added') AS added, "
    "count(*) FILTER (change = 'updated') AS updated, "
    "count(*) FILTER (change = 'unchanged') AS unchanged, "
    "count(*) FILTER (change = 'removed') AS removed"))
def _(t: Sample):
    return diff_counts({"orders": _diff(t)})


@query("removed_keys", f"""WITH {SEED_SQL}
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seed)
""")
def _(t: Sample):
    return removed_keys(order_seed(t), t.orders, ORDERS)


@query("diff_null_safe", """
SELECT CAST(event_id AS VARCHAR) AS key,
  CASE WHEN event_type IN ('error', 'click') THEN 'unchanged' ELSE 'updated' END AS change
FROM events
""")
def _(t: Sample):
    # click: null on both sides; view, signup, purchase: null on one side only.
    spec = TableSpec("events", (int_col("event_id"), ColumnSpec("value", "float", bits=64)), ("event_id",))

    def nulled(*kinds):
        return t.events.select("event_id", F.when(~F.col("event_type").isin(*kinds), F.col("value")).alias("value"))

    return row_diff(nulled("click", "view"), nulled("click", "signup", "purchase"), spec).select(
        F.array_join("key", ", ").alias("key"), "change")


@query("row_violations", """
SELECT 'documents' AS "table", 'max_length' AS rule, 'text' AS "column", CAST(doc_id AS VARCHAR) AS key,
  CAST(length(text) AS VARCHAR) AS value FROM documents WHERE length(text) > 4000
UNION ALL SELECT 'documents', 'enum_label', 'lang', CAST(doc_id AS VARCHAR), lang
  FROM documents WHERE lang NOT IN ('en', 'fr') AND source <> 'src3'
UNION ALL SELECT 'documents', 'not_null', 'lang', CAST(doc_id AS VARCHAR), NULL
  FROM documents WHERE source = 'src3'
""")
def _(t: Sample):
    spec = TableSpec(
        "documents",
        (int_col("doc_id"), text_col("text", 4000),
         ColumnSpec("lang", "enum", type_name="lang", labels=("en", "fr"), nullable=False)),
        ("doc_id",),
    )
    docs = t.documents.select(
        "doc_id", "text", F.when(F.col("source") != "src3", F.col("lang")).alias("lang"))
    return check_rows(docs, spec)


@query("check_duplicates", """
SELECT 'lines' AS "table", 'duplicate_key' AS rule, 'l_orderkey, l_linenumber' AS "column",
  l_orderkey || ', ' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS value
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def _(t: Sample):
    line = SCHEMA.tables["lineitem"]
    spec = TableSpec("lines", line.columns, ("l_orderkey", "l_linenumber"))
    return check_rows(t.lineitem, spec)


@query("unique_violations", """
SELECT 'orders' AS "table", 'unique' AS rule, 'o_custkey, o_orderdate' AS "column",
  o_custkey || ', ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS key,
  CAST(count(*) AS VARCHAR) AS value
FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1
UNION ALL SELECT 'orders', 'unique', 'o_orderpriority, o_custkey', o_orderpriority || ', ' || o_custkey,
  CAST(count(*) AS VARCHAR) FROM orders WHERE o_totalprice > 400000
GROUP BY o_orderpriority, o_custkey HAVING count(*) > 1
""")
def _(t: Sample):
    spec = replace(ORDERS, unique=(
        UniqueKey(("o_custkey", "o_orderdate")),
        UniqueKey(("o_orderpriority", "o_custkey"), "o_totalprice > 400000"),
    ))
    return unique_violations(t.orders, spec)


@query("parse_failures", f"""
WITH raw AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR)
    WHEN 'view' THEN {dbl('value')} WHEN 'signup' THEN strftime(ts, '%Y-%m-%d')
    WHEN 'error' THEN props ELSE event_type END AS raw FROM events)
SELECT event_type, count(*) FILTER (NOT regexp_matches(raw, '^[0-9]+$')) AS bad_int,
  count(*) FILTER (event_type NOT IN ('click', 'view')) AS bad_float,
  count(*) FILTER (event_type <> 'signup') AS bad_date,
  count(*) FILTER (event_type IN ('signup', 'purchase')) AS bad_json,
  count(*) FILTER (raw NOT IN ('0', '1')) AS bad_bool FROM raw GROUP BY event_type
""")
def _(t: Sample):
    kinds = F.col("event_type")
    raw = (
        F.when(kinds == "click", F.col("user_id").cast("string"))
        .when(kinds == "view", F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""))
        .when(kinds == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(kinds == "error", F.col("props")).otherwise(kinds)
    )
    rows = t.events.select("event_type", raw.alias("raw"))
    return rows.groupBy("event_type").agg(*[
        F.count_if(parse_failed(F.col("raw"), ColumnSpec("raw", k))).alias(f"bad_{k}")
        for k in ("int", "float", "date", "json", "bool")
    ])


@query("verify_tables", """
SELECT 'orders' AS "table", 'row_count' AS rule,
  (SELECT count(*) FROM orders) || ' rows, ' ||
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') || ' recorded' AS value
UNION ALL SELECT 'customer', 'content', NULL
UNION ALL SELECT 'part', 'missing', 'no rows, ' || (SELECT count(*) FROM part) || ' recorded'
UNION ALL SELECT 'region', 'not_recorded',
  (SELECT count(*) FROM region) || ' rows, none recorded'
""")
def _(t: Sample):
    recorded = table_digests({
        "orders": t.orders.filter("o_orderstatus <> 'P'"),
        "customer": t.customer.withColumn("c_acctbal", F.col("c_acctbal") + 1),
        "supplier": t.supplier, "part": t.part,
    }, SCHEMA.tables)
    now = t.some("orders", "customer", "supplier", "region")
    return verify_tables(now, SCHEMA.tables, recorded).select("table", "rule", "value")


@query("post_merge_refs", f"""WITH {SEED_SQL},
o AS (SELECT * FROM seed UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seed)),
c AS (SELECT * FROM customer WHERE c_acctbal > 0)
SELECT 'orders' AS child, 'customer' AS parent, count(DISTINCT o_custkey) AS missing
FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
""")
def _(t: Sample):
    targets = t.some("orders", "customer", "nation", "region")
    seeds = {"orders": order_seed(t), "customer": t.customer.filter("c_acctbal > 0")}
    slices = {"orders": SliceSpec("orders"), "customer": SliceSpec("customer", load="truncate_first")}
    schema = replace(SCHEMA, tables={n: SCHEMA.tables[n] for n in targets})
    merged = merge_tables(targets, seeds, schema, slices).tables
    return check_references(merged, schema, examples=0).select("child", "parent", "missing")


@query("load_plan", """
SELECT 1 AS position, 'part' AS "table", count(*) AS rows, 'skip_existing' AS mode, 'p_partkey' AS key, false AS destructive FROM part
UNION ALL SELECT 2, 'region', count(*), 'upsert', 'r_regionkey', false FROM region
UNION ALL SELECT 3, 'nation', count(*), 'upsert', 'n_nationkey', false FROM nation
UNION ALL SELECT 4, 'customer', count(*), 'truncate_first', 'c_custkey', true FROM customer
UNION ALL SELECT 5, 'orders', count(*), 'upsert', 'o_orderkey', false FROM orders
UNION ALL SELECT 6, 'supplier', count(*), 'upsert', 's_suppkey', false FROM supplier
UNION ALL SELECT 7, 'lineitem', count(*), 'insert', '', false FROM lineitem
""")
def _(t: Sample):
    slices = [
        SliceSpec("lineitem", load="insert"), SliceSpec("supplier"), SliceSpec("orders"),
        SliceSpec("part", load="skip_existing"), SliceSpec("customer", load="truncate_first"),
        SliceSpec("nation"), SliceSpec("region"),
    ]
    plan = load_plan(t.some(*[s.table for s in slices]), SCHEMA, slices)
    return plan.select("position", "table", "rows", "mode", F.array_join("key", ", ").alias("key"), "destructive")


@query("load_end_to_end", f"""
WITH {SEED_SQL},
more AS (SELECT c_custkey + 1000000000 AS c_custkey, c_nationkey FROM customer WHERE c_custkey % 10 = 0),
merged AS (SELECT * FROM seed UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seed))
SELECT 'orders' AS "table", 'upsert' AS mode, (SELECT count(*) FROM seed) AS rows, (SELECT count(*) FROM seed) AS affected,
  CAST(0 AS BIGINT) AS deleted, (SELECT count(*) FROM merged) AS held, (SELECT max(o_orderkey) + 1 FROM merged) AS next
UNION ALL SELECT 'customer', 'skip_existing', (SELECT count(*) FROM more) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0),
  (SELECT count(*) FROM more), 0, (SELECT count(*) FROM customer) + (SELECT count(*) FROM more),
  (SELECT max(c_custkey) + 1 FROM more)
UNION ALL SELECT 'region', 'truncate_first', (SELECT count(*) FROM region), (SELECT count(*) FROM region),
  (SELECT count(*) FROM region), (SELECT count(*) FROM region), (SELECT max(r_regionkey) + 1 FROM region)
""")
def _(t: Sample):
    """Three tables merged in three modes, checked, published together, and read back from the commit."""
    targets = t.some("orders", "customer", "nation", "region")
    key = F.col("c_custkey")
    fresh = t.customer.filter(key % 10 == 0).withColumn("c_custkey", key + 1_000_000_000)
    seeds = {"orders": order_seed(t), "customer": t.customer.filter(key % 3 == 0).unionByName(fresh), "region": t.region}
    slices = [SliceSpec("orders", load="upsert"), SliceSpec("customer", load="skip_existing"),
              SliceSpec("region", load="truncate_first")]
    root = scratch(t.spark, f"{ensure_checkpoint_dir(t.spark)}/load-{uuid.uuid4().hex}")
    done = load(targets, seeds, SchemaSpec({n: SCHEMA.tables[n] for n in targets}), slices, root, allow_truncate=["region"])
    held = row_counts({n: t.spark.read.parquet(p) for n, p in committed(t.spark, root).items()}).withColumnRenamed("rows", "held")
    return done.results.join(held, "table").join(done.identities, "table").select(
        "table", "mode", "rows", "affected", "deleted", "held", "next")
