"""Contract walks over nested documents, rule by rule."""

import pytest
from pyspark.sql import functions as F

from tableslice.errors import SpecError
from tableslice.operators.contracts import contract_violations

CONTRACT = {
    "bsonType": "object", "required": ["_id", "tags"],
    "properties": {
        "_id": {"bsonType": ["objectId", "int"]},
        "tags": {"bsonType": "array", "items": {"enum": ["a", "b", 3, None]}},
        "it's.odd": {"bsonType": "bool"},
        "grid": {"items": {"items": {"bsonType": "number"}}},
        "at": {"required": ["x"], "properties": {"x": {"bsonType": "date"}, "y": {"required": ["z"]}}},
    },
}

DOCS = {
    '{"_id":1,"tags":["a","b",3,null]}': [],
    '{"_id":{"$oid":"0123456789abcdef01234567"},"tags":[]}': [],
    '{"_id":"1","tags":["c",true]}': [("_id", "bsonType", "string"), ("tags[0]", "enum", '"c"'), ("tags[1]", "enum", "true")],
    '{}': [("_id", "required", None), ("tags", "required", None)],
    '[]': [("$", "bsonType", "array")],
    '7': [("$", "bsonType", "int")],
    '{"_id":null,"tags":null}': [("_id", "bsonType", "null"), ("tags", "bsonType", "null")],
    '{"_id":1,"tags":[],"it\'s.odd":0}': [("it's.odd", "bsonType", "int")],
    '{"_id":1,"tags":[],"grid":[[1,2.5],["x"],7,[[]]]}': [
        ("grid[1][0]", "bsonType", "string"), ("grid[3][0]", "bsonType", "array")],
    '{"_id":1,"tags":[],"at":{}}': [("at.x", "required", None)],
    '{"_id":1,"tags":[],"at":{"x":{"$date":"2020-01-01T00:00:00Z"},"y":{"z":null}}}': [],
    '{"_id":1,"tags":[],"at":{"x":1,"y":{}}}': [("at.x", "bsonType", "int"), ("at.y.z", "required", None)],
    '{"_id":1,"tags":[],"at":[1]}': [],
}


def test_every_rule(spark):
    docs = spark.createDataFrame([*enumerate(DOCS), (99, None)], "n int, text string").withColumn("doc", F.parse_json("text"))
    got = {n: [] for n in range(len(DOCS))}
    for r in contract_violations(docs, CONTRACT, F.col("n")).collect():
        got[r["id"]].append((r["path"], r["rule"], r["found"]))
    order = lambda x: sorted(x, key=str)
    assert {n: order(v) for n, v in got.items()} == {n: order(v) for n, v in enumerate(DOCS.values())}


def test_limits(spark):
    docs = spark.sql("SELECT 1 AS n, parse_json('{}') AS doc")
    assert contract_violations(docs, {}, F.col("n")).count() == 0
    deep = {}
    for _ in range(14):
        deep = {"properties": {"x": deep}}
    with pytest.raises(SpecError, match="nests deeper"):
        contract_violations(docs, deep, F.col("n"))


def test_a_document_is_parsed_once(spark):
    """Every level of rules used to repeat the expressions above it, down to the parsing of the text."""
    rule = {"bsonType": "int"}
    for _ in range(5):
        rule = {"bsonType": "object", "required": ["x"], "properties": {"x": rule}}
    text = '{"x":' * 5 + '"7"' + "}" * 5
    docs = spark.range(3).selectExpr("id AS n", f"parse_json(concat('{text}', repeat(' ', int(id)))) AS doc")
    found = contract_violations(docs, rule, F.col("n"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 or plan.lower().count("parse_json") == 1
    assert len(plan) < 200_000
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(n, "x.x.x.x.x", "bsonType", "string") for n in range(3)]
