"""Constraints after a merge, defaults, key types, repeated ids, and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.canonical import parse_text
from ..operators.checks import indexed_violations, row_violations
from ..operators.contracts import contract_violations
from ..operators.diff import removed_keys, row_diff
from ..operators.documents import filter_document
from ..operators.merge import merge_documents, merge_upsert
from ..session import ensure_checkpoint_dir, scratch, spread
from ..sources.files import read_csv, read_jsonl, read_per_row, write_csv, write_jsonl, write_per_row
from ..spec import ColumnSpec, SliceSpec, TableSpec, UniqueKey, double_col, int_col, text_col
from .load import cut_slice, export_slice, load_violations, verify_export
from .registry import Sample, query
from .testmodel import SCHEMA

_ACCOUNTS = TableSpec(
    "accounts",
    (int_col("c_custkey"), text_col("c_name"), text_col("c_mktsegment", nullable=False),
     double_col("c_acctbal"), int_col("c_nationkey", 32)),
    ("c_custkey",), unique=(UniqueKey(("c_name",)), UniqueKey(("c_nationkey", "c_acctbal"), "c_nationkey < 0")),
)


@query("load_violations", """
SELECT 'accounts' AS "table", 'unique' AS rule, 'c_name' AS "column", c_name AS key, '2' AS value
FROM customer WHERE c_nationkey = 1
UNION ALL SELECT 'accounts', 'not_null', 'c_mktsegment', CAST(-1 - c_custkey AS VARCHAR), NULL
FROM customer WHERE c_nationkey = 2
UNION ALL SELECT 'accounts', 'unique', 'c_nationkey, c_acctbal',
  CAST(-c_nationkey AS VARCHAR) || ', 0', CAST(count(*) AS VARCHAR)
FROM customer WHERE c_nationkey = 3 GROUP BY c_nationkey HAVING count(*) > 1
""")
def _(t: Sample):
    """A seed that repeats names, lacks a needed value, and repeats a partial key inside its predicate."""
    held = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey"]
    target = t.customer.select(*held)
    nation = F.col("c_nationkey")
    seed = target.filter(nation.isin(1, 2, 3)).select(
        (-1 - F.col("c_custkey")).alias("c_custkey"),
        F.when(nation == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit("-new"))).alias("c_name"),
        F.when(nation != 2, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(nation == 3, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(nation == 3, -nation).otherwise(nation).alias("c_nationkey"))
    return load_violations({"accounts": merge_upsert(target, seed, _ACCOUNTS)},
                           type(SCHEMA).of(_ACCOUNTS))


_PLANS = TableSpec(
    "plans",
    (int_col("c_custkey"), double_col("c_acctbal"), text_col("plan", default="'free'"),
     text_col("note"), text_col("plan_upper", computed="upper(plan)")),
    ("c_custkey",),
)


def _plans(t: Sample):
    return t.customer.select(
        "c_custkey", "c_acctbal", F.col("c_mktsegment").alias("plan"),
        F.lit("kept").alias("note"), F.lit("stale").alias("plan_upper"))


@query("merge_defaults", """
SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment AS plan, 'kept' AS note, upper(c_mktsegment) AS plan_upper
FROM customer
UNION ALL SELECT -1 - c_custkey, c_acctbal + 1, 'free', NULL, 'FREE' FROM customer
""")
def _(t: Sample):
    """New rows get the default, known ones keep their value; the computed column follows in both."""
    target = _plans(t)
    seed = target.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    seed = seed.unionAll(seed.select(-1 - F.col("c_custkey"), "c_acctbal"))
    return merge_upsert(target, seed, _PLANS)


@query("merge_generated", """
SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey < 7 THEN 'pro' ELSE c_mktsegment END AS plan,
  'kept' AS note, CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey < 7 THEN 'PRO' ELSE 'stale' END AS plan_upper
FROM customer
""")
def _(t: Sample):
    """Recomputed where the seed touches a row, also to NULL: an explicit NULL is no default."""
    seed = t.customer.filter("c_nationkey <= 7").select(
        "c_custkey", F.when(F.col("c_nationkey") < 7, "pro").alias("plan"))
    return merge_upsert(_plans(t), seed, _PLANS)


@query("merge_key_types", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT 2000000000 + o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey < 100000000
""")
def _(t: Sample):
    """A seed whose key and value have other types; the target's stay."""
    spec = TableSpec("orders", (int_col("o_orderkey"), double_col("o_totalprice")), ("o_orderkey",))
    rows = t.orders.filter("o_orderpriority = '1-URGENT'")
    seed = rows.select(F.col("o_orderkey").cast("decimal(20,0)").alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    fresh = rows.filter("o_orderkey < 100000000").select(
        (F.col("o_orderkey") + 2000000000).cast("decimal(20,0)"), F.col("o_totalprice") + 1)
    return merge_upsert(t.orders.select("o_orderkey", "o_totalprice"), seed.unionAll(fresh), spec)


def _keyed(t: Sample, keep: str, price):
    return t.orders.select(F.when(F.expr(keep), F.col("o_orderkey")).alias("k"), price.alias("p"))


_NULLABLE = TableSpec("nullable", (int_col("k"), double_col("p")), unique=(UniqueKey(("k",)),))


@query("diff_null_keys", """
WITH live AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k, o_totalprice AS p FROM orders),
seed AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS k, o_totalprice + 5 AS p FROM orders)
SELECT CASE WHEN l.k IS NULL THEN 'added' ELSE 'updated' END AS change, s.k IS NULL AS null_key, count(*) AS n
FROM seed s LEFT JOIN live l ON s.k = l.k GROUP BY ALL
""")
def _(t: Sample):
    """A third of the keys is null; those rows are added, and no two of them pair."""
    live = _keyed(t, "o_orderstatus <> 'P'", F.col("o_totalprice"))
    seed = _keyed(t, "o_orderpriority <> '5-LOW'", F.col("o_totalprice") + 5)
    return row_diff(seed, live, _NULLABLE).groupBy(
        "change", F.col("key")[0].isNull().alias("null_key")).agg(F.count(F.lit(1)).alias("n"))


@query("removed_null_keys", """
WITH live AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k FROM orders)
SELECT k, count(*) AS n FROM live
WHERE k IS NULL OR k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY k
""")
def _(t: Sample):
    live = _keyed(t, "o_orderstatus <> 'P'", F.col("o_totalprice"))
    seed = _keyed(t, "o_orderpriority <> '5-LOW'", F.col("o_totalprice"))
    return removed_keys(seed, live, _NULLABLE).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("diff_partial_key", """
WITH base AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL)
SELECT CASE WHEN value > 150 THEN 'updated' ELSE 'added' END AS change, count(*) AS n FROM base GROUP BY ALL
""")
def _(t: Sample):
    """Rows outside the predicate of a partial key match nothing."""
    spec = TableSpec("docs", (int_col("user_id"), text_col("event_type"), double_col("value")),
                     unique=(UniqueKey(("user_id", "event_type"), "value > 150"),))
    live = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    seed = live.withColumn("value", F.when(F.col("value") > 150, F.col("value") + 1).otherwise(F.col("value")))
    return row_diff(seed, live, spec).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _repeats(t: Sample):
    return t.events.select((F.col("event_id") % 500).alias("_id"), F.col("event_id").alias("at"))


@query("merge_documents_last_wins", """
SELECT event_id % 500 AS _id, max(event_id) AS at FROM events GROUP BY 1 UNION ALL SELECT -1, -1
""")
def _(t: Sample):
    target = t.events.limit(0).select(F.lit(-1).cast("bigint").alias("_id"), F.lit(-1).cast("bigint").alias("at"))
    one = t.region.filter("r_regionkey = 0").select(
        F.lit(-1).cast("bigint").alias("_id"), F.lit(-1).cast("bigint").alias("at"))
    return merge_documents(target.unionAll(one), _repeats(t), "replace", order=("at",))


@query("merge_documents_first_wins", """
SELECT event_id % 500 AS _id, CASE WHEN event_id % 500 < 100 THEN -1 ELSE min(event_id) END AS at
FROM events GROUP BY event_id % 500
""")
def _(t: Sample):
    target = _repeats(t).filter("_id < 100").select("_id", F.lit(-1).cast("bigint").alias("at")).distinct()
    return merge_documents(target, _repeats(t), "set_on_insert", order=("at",))


def _folder(t: Sample) -> str:
    return scratch(t.spark, f"{ensure_checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}")


@query("jsonl_round_trip", "SELECT * FROM orders")
def _(t: Sample):
    spec, path = SCHEMA.tables["orders"], _folder(t)
    write_jsonl(t.orders, path, spec, compression="gzip")
    return read_jsonl(t.spark, path, spec)


@query("csv_round_trip", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey = 4 THEN NULL
  ELSE c_name || ',"' || chr(10) || c_mktsegment END AS c_name, c_nationkey, c_acctbal,
  CASE WHEN c_nationkey <> 5 THEN c_mktsegment END AS c_mktsegment FROM customer
""")
def _(t: Sample):
    """Empty text, null, quotes, commas and line breaks come back as they were."""
    spec, path, n = SCHEMA.tables["customer"], _folder(t), F.col("c_nationkey")
    rows = t.customer.withColumn("c_name", F.when(n == 3, "").when(n == 4, None).otherwise(
        F.concat("c_name", F.lit(',"\n'), "c_mktsegment")))
    rows = rows.withColumn("c_mktsegment", F.when(n != 5, F.col("c_mktsegment")))
    write_csv(rows, path, spec)
    return read_csv(t.spark, path, spec)


@query("per_row_round_trip", "SELECT * FROM nation")
def _(t: Sample):
    spec, path = SCHEMA.tables["nation"], _folder(t)
    write_per_row(t.nation, path, spec)
    return read_per_row(t.spark, path, spec)


_TEXTS = TableSpec("texts", (
    int_col("o_orderkey"), int_col("n", 16), ColumnSpec("d", "date"), ColumnSpec("j", "json"), ColumnSpec("b", "bool")),
    ("o_orderkey",))


@query("read_back_violations", """
SELECT 'texts' AS "table", 'parse' AS rule, "column", CAST(o_orderkey AS VARCHAR) AS key, value FROM (
  SELECT o_orderkey, 'n' AS "column", CAST(o_orderkey * 1000 AS VARCHAR) AS value FROM orders WHERE o_orderkey * 1000 > 32767
  UNION ALL SELECT o_orderkey, 'd', '2023-02-30' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'j', '{"a":' FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 'b', o_orderpriority FROM orders)
""")
def _(t: Sample):
    """Every value that does not parse, by key and column; a repeated JSON key does."""
    s = F.col("o_orderstatus")
    texts = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), (F.col("o_orderkey") * 1000).cast("string").alias("n"),
        F.when(s == "F", "2023-02-30").otherwise("2024-02-29").alias("d"),
        F.when(s == "O", '{"a":').otherwise('{"a":1,"a":2}').alias("j"), F.col("o_orderpriority").alias("b"))
    return row_violations(texts, _TEXTS, parse=True)


@query("parse_uuid_zoned", """
SELECT event_id, '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS u,
  strftime(ts - INTERVAL 120 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events
""")
def _(t: Sample):
    """UUID spellings and timestamps with a zone."""
    plain = F.concat(F.lit("{00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("}"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return t.events.select(
        "event_id", parse_text(plain, ColumnSpec("u", "uuid")).alias("u"),
        F.date_format(parse_text(stamp, ColumnSpec("at", "timestamp", tz=True)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))


@query("verify_export", """
SELECT 'orders' AS "table", 'row_count' AS rule, NULL AS "column", NULL AS key,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') || ' rows, ' || (SELECT count(*) FROM orders) || ' recorded' AS value
UNION ALL SELECT 'customer', 'content', NULL, NULL, NULL
""")
def _(t: Sample):
    """A slice is committed with its record; changed tables are then held against it."""
    root = _folder(t)
    tables = t.some("orders", "customer")
    slices = [SliceSpec("orders"), SliceSpec("customer")]
    export_slice(cut_slice(tables, SCHEMA, slices), root, schema=SCHEMA, allow_dangling=True)
    changed = {
        "orders": tables["orders"].filter("o_orderstatus <> 'P'"),
        "customer": tables["customer"].withColumn("c_acctbal", F.col("c_acctbal") + 1),
    }
    return verify_export(t.spark, root, SCHEMA, changed)


@query("filter_documents_variant", """
SELECT event_id FROM events
WHERE (event_type IN ('view', 'click') AND event_id % 3 <> 0)
   OR (event_id % 7 = 0 AND event_id % 2 = 1)
""")
def _(t: Sample):
    """Dotted paths into a VARIANT; texts and numbers do not equal each other, absent fields equal null."""
    n = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), n.cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","meta":{"mod":'),
        (n % 7).cast("string"), F.when(n % 2 == 1, ',"odd":null').otherwise(',"odd":"1"'), F.lit("}"),
        F.when(n % 3 == 0, ',"third":3').otherwise(F.lit("")), F.lit("}"))
    docs = t.events.select("event_id", F.parse_json(text).alias("doc"))
    rule = {"$or": [
        {"kind": {"$in": ["view", "click"]}, "third": {"$exists": False}},
        {"meta.mod": {"$gte": 0, "$lt": 1}, "meta.odd": None, "kind": {"$ne": 7}},
        {"meta.odd": 1}, {"id": {"$in": ["1", "2"]}},
    ]}
    return docs.filter(filter_document(rule, F.col("doc"))).select("event_id")


_PARTS = TableSpec("parts", (
    int_col("l_orderkey"), int_col("l_linenumber", 32), text_col("l_returnflag", 0), double_col("l_quantity")),
    unique=(UniqueKey(("l_orderkey",)),))


@query("indexed_violations", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_returnflag, l_quantity) AS row_index
           FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'x' ELSE '' END AS l_returnflag, l_quantity
                 FROM lineitem))
SELECT 'parts' AS "table", 'max_length' AS rule, 'l_returnflag' AS "column", row_index,
  CAST(l_orderkey AS VARCHAR) AS key, '1' AS value FROM n WHERE l_returnflag = 'x'
UNION ALL SELECT 'parts', 'duplicate_key', 'l_orderkey', min(row_index) + 1, CAST(l_orderkey AS VARCHAR),
  CAST(min(row_index) AS VARCHAR) FROM n GROUP BY l_orderkey HAVING count(*) > 1
""")
def _(t: Sample):
    """Rows too long and rows that repeat a key, by their number under the total order."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(
        F.col("l_quantity") > 45, "x").otherwise("").alias("l_returnflag"), "l_quantity")
    return indexed_violations(rows, _PARTS, SliceSpec("parts", load="insert", order_by=("l_orderkey",)))


@query("contract_violations", """
WITH d AS (SELECT *, 'size: ' || p_size AS label FROM part)
SELECT p_partkey AS id, 'size' AS path, 'bsonType' AS rule, 'string' AS found FROM d WHERE p_size % 5 = 0
UNION ALL SELECT p_partkey, 'info.brand', 'required', NULL FROM d WHERE p_size % 7 = 0
UNION ALL SELECT p_partkey, 'info.kind', 'enum', '"' || p_type || '"' FROM d
  WHERE p_type NOT IN (SELECT min(p_type) FROM part)
UNION ALL SELECT p_partkey, 'marks[1].n', 'bsonType', 'string' FROM d WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'marks[' || i || '].at', 'required', NULL FROM d, (VALUES (0), (1)) x(i)
  WHERE i = 0 AND p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'marks', 'bsonType', 'null' FROM d WHERE false
""")
def _(t: Sample):
    """Nested documents made of parts, against a contract whose labels come from the rows."""
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit('{"_id":'), F.col("p_partkey").cast("string"), F.lit(',"size":'),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size),
        F.lit(',"info":{"kind":"'), "p_type", F.lit('"'),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.lit(',"brand":null')),
        F.lit('},"marks":[{"n":1'), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.lit(',"at":2')),
        F.lit('},{"at":3,"n":'), F.when(F.col("p_size") % 3 == 0, F.lit('"x"')).otherwise(F.lit("4")), F.lit("}]}"))
    docs = spread(t.part.select("p_partkey", "p_size", "p_type")).select("p_partkey", F.parse_json(text).alias("doc"))
    contract = {"bsonType": "object", "required": ["_id", "size", "info"], "properties": {
        "size": {"bsonType": "number"},
        "info": {"bsonType": "object", "required": ["brand", "kind"], "properties": {
            "kind": {"enum": [t.part.agg(F.min("p_type")).first()[0]]}, "brand": {"bsonType": ["string", "null"]}}},
        "marks": {"bsonType": ["array", "null"], "items": {
            "bsonType": "object", "required": ["at"], "properties": {"n": {"bsonType": ["int", "long"]}}}},
        "absent": {"bsonType": "string", "required": ["x"]},
    }}
    return contract_violations(docs, contract, F.col("p_partkey"))
