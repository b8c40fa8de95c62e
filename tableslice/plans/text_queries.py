"""Text forms: floats, JSON, CSV, SQL, slugs, names, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import (
    canonicalize, comparison_text, float_text, parse_canonical, parse_stamp, parse_text, parse_time,
    to_text,
)
from ..functions.jsontext import canonical_json
from ..functions.names import slug, suggestion
from ..sources.files import csv_row, json_row, sql_insert_lines
from ..spec import ColumnSpec, TableSpec, int_col, text_col
from .registry import Sample, dbl, query, stamp
from .testmodel import SCHEMA


@query("canonical_float", f"""
SELECT o_orderkey, {dbl('o_totalprice * 1.1 / 7')} AS scaled,
  {dbl('o_totalprice / 1000000')} AS small, {dbl('-round(o_totalprice) * 1000')} AS whole FROM orders
""")
def _(t: Sample):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", float_text(p * F.lit(1.1) / 7).alias("scaled"),
        float_text(p / 1000000).alias("small"), float_text(-F.round(p) * 1000).alias("whole"),
    )


@query("json_canonical", """
SELECT event_id, '{"at":' || chr(123) || '"type":"' || event_type || '"},"k":'
  || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"v":[' || user_id || ',1.50]}' AS doc FROM events
""")
def _(t: Sample):
    raw = F.format_string(
        '{"v": [%d, 1.50], "k": %s, "at": {"type":"%s"}}', "user_id",
        F.get_json_object("props", "$.k"), "event_type")
    return t.events.select("event_id", canonical_json(raw).alias("doc"))


@query("json_comparison", """
SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props FROM events
""")
def _(t: Sample):
    return t.events.select(
        "event_id", comparison_text(F.col("props"), ColumnSpec("props", "json")).alias("props"))


@query("json_rows", f"""
SELECT '{{"event_id":' || event_id || ',"ts":"' || {stamp('ts')} || '","user_id":' || user_id
  || ',"event_type":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END
  || ',"value":' || {dbl('value')} || ',"props":{{"k":'
  || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}}}' AS line FROM events
""")
def _(t: Sample):
    rows = t.events.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return rows.select(json_row(rows, SCHEMA.tables["events"]).alias("line"))


@query("json_rows_text", """
SELECT '{"doc_id":' || doc_id || ',"text":"' ||
  replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'),
    chr(13), '\\r'), chr(9), '\\t') || '"}' AS line FROM documents
""")
def _(t: Sample):
    rows = t.documents.select("doc_id", "text")
    return rows.select(json_row(rows, SCHEMA.tables["documents"]).alias("line"))


@query("csv_rows", """
SELECT doc_id || ',' || CASE WHEN text = '' OR regexp_matches(text, '[,"\\r\\n]|^ | $')
  THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' ||
  CASE WHEN lang = 'en' THEN '' ELSE lang END || ',""' AS line FROM documents
""")
def _(t: Sample):
    rows = t.documents.select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"), F.lit("").alias("source"))
    return rows.select(csv_row(rows, SCHEMA.tables["documents"]).alias("line"))


_SLUG_SQL = (
    "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '-')"
)


def _slug_sql(expr: str) -> str:
    body = _SLUG_SQL.format(expr)
    return (
        f"CASE WHEN {expr} IS NULL THEN 'null' WHEN {body} = '' THEN 'empty' "
        f"WHEN length({body}) > 48 THEN substr({body}, 1, 40) || '-' || substr(sha256({expr}), 1, 8) "
        f"ELSE {body} END"
    )


@query("slug", f"""
SELECT p_partkey, {_slug_sql("p_name || ' / ' || p_brand || ' (' || p_type || ')'")} AS slug FROM part
""")
def _(t: Sample):
    label = F.format_string("%s / %s (%s)", "p_name", "p_brand", "p_type")
    return t.part.select("p_partkey", slug(label).alias("slug"))


@query("slug_long", f"SELECT page_id, {_slug_sql('url')} AS slug, {_slug_sql('html')} AS body FROM pages")
def _(t: Sample):
    return t.pages.select(
        "page_id", slug(F.col("url")).alias("slug"), slug(F.col("html")).alias("body"))


_TUPLE_SQL = (
    "'(' || c_custkey || ', ''' || replace(c_name, '''', '''''') || '''::text, ' || "
    f"CASE WHEN c_nationkey = 3 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END || ', ' || "
    f"{dbl('c_acctbal')} || ', ''' || c_mktsegment || '''::text)'"
)


@query("sql_insert_lines", f"""
SELECT i AS row_index,
  CASE WHEN (i - 1) % 100 = 0 THEN
    'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") VALUES'
    || chr(10) ELSE '' END
  || '  ' || {_TUPLE_SQL} || CASE WHEN i % 100 = 0 OR i = n THEN ';' ELSE ',' END AS value
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n FROM customer)
""")
def _(t: Sample):
    rows = t.customer.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return sql_insert_lines(rows, SCHEMA.tables["customer"])


_WANTED = "replace(lower(p_name), ' ', '_')"
_KNOWN_WORDS = ("blue_plates", "old_bolts", "hot_rods", "largegear", "new_widget", "small_ring")


@query("did_you_mean", f"""
WITH w AS (SELECT DISTINCT {_WANTED} AS wanted FROM part),
k AS (SELECT unnest([{', '.join(repr(w) for w in _KNOWN_WORDS)}]) AS known),
p AS (SELECT wanted, known, levenshtein(wanted, known) AS d FROM w, k
      WHERE levenshtein(wanted, known) * 3 <= greatest(length(wanted), length(known))),
b AS (SELECT wanted, known, row_number() OVER (PARTITION BY wanted ORDER BY d, known) AS rn FROM p)
SELECT p_partkey, known AS suggestion FROM part
LEFT JOIN b ON b.wanted = {_WANTED} AND b.rn = 1
""")
def _(t: Sample):
    wanted = F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))
    return t.part.select("p_partkey", suggestion(wanted, _KNOWN_WORDS).alias("suggestion"))


@query("parse_round_trip", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def _(t: Sample):
    spec = SCHEMA.tables["orders"]
    return parse_canonical(canonicalize(t.orders, spec), spec)


@query("parse_stamps", """
SELECT event_id,
  strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') AS folded,
  strftime(ts, '%H:%M:%S') AS clock, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
""")
def _(t: Sample):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.events.select(
        "event_id",
        F.date_format(parse_stamp(F.concat(text, F.lit("+05:30")), False),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("folded"),
        parse_time(F.date_format("ts", "H:m:s'-03'")).alias("clock"),
        F.date_format(parse_text(F.date_format("ts", "yyyy-M-d"), ColumnSpec("d", "date")),
                      "yyyy-MM-dd").alias("day"),
    )


@query("bytes_text", """
SELECT page_id, '\\x' || lower(hex(encode(url))) AS raw, url AS back FROM pages
""")
def _(t: Sample):
    kind = ColumnSpec("raw", "bytes")
    raw = to_text(F.encode("url", "utf-8"), kind)
    return t.pages.select(
        "page_id", raw.alias("raw"),
        F.decode(parse_text(F.upper(raw).substr(F.lit(3), F.length(raw)), kind), "utf-8").alias("back"))


_DECIMALS = TableSpec("money", (
    int_col("o_orderkey"), ColumnSpec("price", "decimal", precision=14, scale=4),
    ColumnSpec("wide", "decimal"), text_col("note")), ("o_orderkey",))


@query("decimal_rows", """
SELECT '{"o_orderkey":' || o_orderkey || ',"price":' || CAST(CAST(o_totalprice AS DECIMAL(14,4)) AS VARCHAR)
  || ',"wide":' || CASE WHEN o_orderstatus = 'F' THEN '"NaN"' WHEN o_orderstatus = 'O' THEN '"1.5e3"'
     ELSE o_orderkey || '.1234567890123456789012345678901234567890' END || '}' AS line FROM orders
""")
def _(t: Sample):
    s = F.col("o_orderstatus")
    wide = F.when(s == "F", "NaN").when(s == "O", "1.5e3").otherwise(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".1234567890123456789012345678901234567890")))
    rows = t.orders.select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(14,4)").alias("price"), wide.alias("wide"))
    return rows.select(json_row(rows, _DECIMALS).alias("line"))
