"""Documents and stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import (
    documents_to_table, field_class, profile_fields, profile_flags, sample_documents,
    table_to_documents,
)
from ..operators.drift import bucket_drift
from ..operators.objects import (
    manifest_digest, manifest_totals, object_manifest, object_violations, sync_plan, under_prefix,
    verify_objects,
)
from ..spec import ColumnSpec, TableSpec, int_col, text_col
from .registry import Sample, dbl, query, stamp
from .testmodel import SCHEMA


def _documents(t: Sample) -> DataFrame:
    """Events as documents of differing shape."""
    text = (
        F.when(F.col("event_type") == "click", F.format_string(
            '{"_id": %d, "score": %s, "meta": %s}', "event_id", "user_id", "props"))
        .when(F.col("event_type") == "error", F.format_string(
            '{"_id": %d, "score": "high", "meta": null}', "event_id"))
        .when(F.col("event_type") == "view", F.format_string(
            '{"_id": %d, "at": {"$date": "%sZ"}, "n": {"$numberLong": "%d"}}', "event_id",
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "user_id"))
        .otherwise(F.format_string('{"_id": %d, "tags": ["a", %d]}', "event_id", "user_id"))
    )
    return t.events.select(F.parse_json(text).alias("doc"))


_KIND = "count(*) FILTER (event_type = '{}')"
_PROFILE_SQL = f"""
WITH c AS (SELECT count(*) AS n, {_KIND.format('click')} AS click, {_KIND.format('error')} AS error,
             {_KIND.format('view')} AS viewed FROM events)
SELECT '_id' AS name, 'int' AS types, n AS present, n AS sampled, false AS polymorphic,
  true AS always_present, 'int32' AS class FROM c
UNION ALL SELECT 'score', 'int,string', click + error, n, true, false, 'jsonb' FROM c
UNION ALL SELECT 'meta', 'null,object', click + error, n, true, false, 'jsonb' FROM c
UNION ALL SELECT 'at', 'date', viewed, n, false, false, 'timestamptz' FROM c
UNION ALL SELECT 'n', 'long', viewed, n, false, false, 'int64' FROM c
UNION ALL SELECT 'tags', 'array', n - click - error - viewed, n, false, false, 'jsonb' FROM c
"""


@query("field_profile", _PROFILE_SQL)
def _(t: Sample):
    profile = profile_flags(profile_fields(_documents(t)))
    return profile.select(
        "name", F.array_join("types", ",").alias("types"), "present", "sampled", "polymorphic",
        "always_present", field_class(F.col("types")).alias("class"))


@query("field_profile_props", """
SELECT 'k' AS name, 'int' AS types, count(*) AS present, count(*) AS sampled FROM events
""")
def _(t: Sample):
    return profile_fields(t.events.select(F.parse_json("props").alias("doc"))).select(
        "name", F.array_join("types", ",").alias("types"), "present", "sampled")


@query("sample_documents", """
SELECT event_id FROM events ORDER BY user_id, event_id LIMIT 1000
""")
def _(t: Sample):
    docs = t.events.select(
        F.parse_json(F.format_string('{"_id": %d}', F.col("user_id") * 10**9 + F.col("event_id")))
        .alias("doc"), "event_id")
    first = sample_documents(docs, F.variant_get("doc", "$._id", "bigint"))
    return first.select("event_id")


@query("documents_to_table", f"""
SELECT event_id AS _id, CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR)
    WHEN 'error' THEN 'high' END AS score,
  CASE WHEN event_type = 'view' THEN ts END AS at, CASE WHEN event_type = 'view' THEN user_id END AS n,
  CASE WHEN event_type = 'click' THEN '{{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}' END AS meta,
  CASE WHEN event_type IN ('signup', 'purchase') THEN '["a",' || user_id || ']' END AS tags FROM events
""")
def _(t: Sample):
    spec = TableSpec("events", (
        int_col("_id", 64), text_col("score"), ColumnSpec("at", "timestamp"), int_col("n", 64),
        ColumnSpec("meta", "json"), ColumnSpec("tags", "json")), ("_id",))
    return documents_to_table(_documents(t), spec)


@query("table_to_documents", f"""
SELECT '{{"event_id":{{"$numberLong":"' || event_id || '"}},"ts":{{"$date":"' || {stamp('ts')} || '"}}' ||
  CASE WHEN event_type = 'view' THEN '' ELSE ',"event_type":"' || event_type || '"' END ||
  ',"value":' || {dbl('value')} || ',"props":{{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR)
  || '}}}}' AS value FROM events
""")
def _(t: Sample):
    rows = t.events.drop("user_id").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return table_to_documents(rows, SCHEMA.tables["events"])


def _objects(t: Sample) -> DataFrame:
    """Pages as stored objects, keyed by number and address."""
    return t.pages.select(
        F.concat_ws("/", F.lit("pages"), F.col("page_id").cast("string"),
                    F.regexp_replace("url", "^[a-z]+://", "")).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "utf-8").alias("content"), "page_id")


_PATH = "'pages/' || page_id || '/' || regexp_replace(url, '^[a-z]+://', '')"
_OBJECTS_SQL = f"""
WITH o AS (SELECT {_PATH} AS path, strlen(html) AS size, sha256(html) AS sha256, page_id FROM pages)
"""


@query("object_manifest", _OBJECTS_SQL + "SELECT path, size, sha256, 'text/html' AS content_type FROM o")
def _(t: Sample):
    return object_manifest(_objects(t), F.lit("text/html"))


_SUMS = ", ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("manifest_digest", _OBJECTS_SQL + f"""
SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_SUMS})) AS sha256
FROM (SELECT sha256(path || chr(0) || size || chr(0) || sha256 || chr(0)) AS h FROM o)
""")
def _(t: Sample):
    return manifest_digest(object_manifest(_objects(t)))


@query("manifest_totals", _OBJECTS_SQL + """
SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM o
""")
def _(t: Sample):
    return manifest_totals(object_manifest(_objects(t)))


@query("object_violations", _OBJECTS_SQL + """
SELECT path, CASE WHEN path LIKE '%//%' OR path LIKE '%/' THEN 'unsafe key: empty segment'
  ELSE size || ' bytes, over the 1500-byte limit' END AS problem
FROM o WHERE path LIKE '%//%' OR path LIKE '%/' OR size > 1500
""")
def _(t: Sample):
    return object_violations(_objects(t), max_bytes=1500)


@query("objects_under_prefix", _OBJECTS_SQL + "SELECT path FROM o WHERE path LIKE 'pages/1/%'")
def _(t: Sample):
    return under_prefix(_objects(t), "pages/1/").select("path")


def _edited(t: Sample) -> DataFrame:
    """Later state of the objects: long ones gone, short ones changed."""
    return _objects(t).filter("length <= 3000").withColumn(
        "content", F.when(F.col("length") < 1200, F.encode(F.lit("edited"), "utf-8"))
        .otherwise(F.col("content")))


@query("verify_objects", _OBJECTS_SQL + """
SELECT path, CASE WHEN size > 3000 THEN 'missing' ELSE 'changed' END AS problem
FROM o WHERE size > 3000 OR size < 1200
""")
def _(t: Sample):
    return verify_objects(_edited(t), object_manifest(_objects(t)))


@query("sync_plan", _OBJECTS_SQL + """
SELECT path, CASE WHEN size > 3000 THEN 'drop' ELSE 'replace' END AS action
FROM o WHERE size > 3000 OR size < 1200
""")
def _(t: Sample):
    return sync_plan(object_manifest(_edited(t)), object_manifest(_objects(t)))


@query("bucket_drift", """
WITH b AS (SELECT 'pages-' || (page_id // 100) AS bucket, max(strlen(html)) AS largest,
             CAST(floor(avg(strlen(html))) AS BIGINT) AS typical FROM pages GROUP BY 1)
SELECT 'breaking' AS severity, bucket, 'file size limit ' || typical ||
  ' is below the largest exported object (' || largest || ' bytes)' AS what
FROM b WHERE typical < largest
UNION ALL SELECT 'benign', bucket, 'file size limit lowered to ' || typical FROM b WHERE typical = largest
UNION ALL SELECT 'benign', bucket, 'public true -> false' FROM b
""")
def _(t: Sample):
    sized = t.pages.select(
        F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 100)).alias("bucket"),
        F.octet_length("html").cast("bigint").alias("size"))
    found = sized.groupBy("bucket").agg(
        F.max("size").alias("largest"), F.floor(F.avg("size")).alias("typical"))
    mimes = F.array(F.lit("text/html")).alias("mime_types")
    recorded = found.select("bucket", F.lit(True).alias("public"),
                            (F.col("largest") + 1).alias("size_limit"), mimes)
    live = found.select("bucket", F.lit(False).alias("public"),
                        F.col("typical").alias("size_limit"), mimes)
    return bucket_drift(recorded, live, found.select("bucket", "largest")).select(
        "severity", "bucket", "what")
