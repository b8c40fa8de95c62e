from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tableslice.errors import DriftBlocked, SpecError
from tableslice.operators.digest import schema_fingerprint
from tableslice.operators.documents import (
    class_for, contract_spec, documents_to_table, field_class, filter_document, profile_fields,
    profile_flags, profile_spec, table_to_documents,
)
from tableslice.operators.checks import check_rows
from tableslice.operators.drift import (
    accept, bucket_drift, carry_accepted, catalog, change_text, drift_counts, drift_report,
    drop_accepted, gate, schema_drift, widens,
)
from tableslice.operators.graph import (
    cycle_members, dependency_levels, fk_edges, load_order, reachable, relatives,
)
from tableslice.spec import (
    ColumnSpec, ForeignKey, SchemaSpec, SliceSpec, TableSpec, UniqueKey, int_col, text_col,
)

USERS = TableSpec("users", (
    int_col("id"), int_col("org_id", 32), text_col("email", 120), ColumnSpec("plan", "enum", type_name="tier"),
    text_col("display"), ColumnSpec("amount", "decimal", precision=14, scale=4),
    ColumnSpec("tags", "array", of=int_col("item", 32)), text_col("must", nullable=False)),
    ("id",), (UniqueKey(("email",)),), (ForeignKey(("org_id",), "orgs", ("id",)),))
ORGS = TableSpec("orgs", (int_col("id"),), ("id",))
BASE = SchemaSpec.of(USERS, ORGS, enums={"tier": ("free", "pro")})


def changed(**columns):
    cols = tuple(columns.get(c.name, c) for c in USERS.columns)
    return replace(USERS, columns=tuple(c for c in cols if c is not None))


def drift(spark, live, recorded=BASE, **kw):
    rows = schema_drift(catalog(spark, recorded), catalog(spark, live), **kw).collect()
    return {(r["severity"], r["table"], r["column"], r["what"]) for r in rows}


def test_no_drift_and_reorder(spark):
    shuffled = replace(USERS, columns=USERS.columns[::-1])
    assert drift(spark, SchemaSpec.of(ORGS, shuffled, enums=BASE.enums)) == set()
    a = catalog(spark, BASE)
    b = catalog(spark, SchemaSpec.of(ORGS, shuffled, enums=BASE.enums))
    prints = [schema_fingerprint(c.columns, c.keys, c.fks, c.enums).first()[0] for c in (a, b)]
    assert prints[0] == prints[1] and len(prints[0]) == 16
    other = catalog(spark, SchemaSpec.of(ORGS, changed(display=text_col("display", 5)), enums=BASE.enums))
    assert schema_fingerprint(other.columns, other.keys, other.fks, other.enums).first()[0] != prints[0]


def test_column_rules(spark):
    live = changed(
        org_id=int_col("org_id", 64), email=text_col("email", 100), display=None,
        amount=ColumnSpec("amount", "decimal", precision=14, scale=6),
        tags=ColumnSpec("tags", "array", of=int_col("item", 64)),
        must=text_col("must", generated=True),
    )
    live = replace(live, columns=live.columns + (
        text_col("a"), text_col("b", nullable=False), text_col("c", nullable=False, has_default=True)))
    got = drift(spark, SchemaSpec.of(ORGS, live, enums=BASE.enums))
    assert got == {
        ("benign", "users", "org_id", "int32 -> int64"),
        ("needs confirmation", "users", "email", "varchar(120) -> varchar(100)"),
        ("needs confirmation", "users", "display", "column dropped (was text)"),
        ("breaking", "users", "amount", "decimal(14,4) -> decimal(14,6)"),
        ("benign", "users", "tags", "int32[] -> int64[]"),
        ("benign", "users", "must", "NOT NULL -> nullable"),
        ("breaking", "users", "must", "column became generated"),
        ("benign", "users", "a", "column added (text, nullable)"),
        ("breaking", "users", "b", "column added (text, NOT NULL with no default)"),
        ("benign", "users", "c", "column added (text, NOT NULL with default)"),
    }


def test_nullability(spark):
    live = changed(display=text_col("display", nullable=False),
                   email=text_col("email", 120, nullable=False, has_default=True))
    assert drift(spark, SchemaSpec.of(ORGS, live, enums=BASE.enums)) == {
        ("breaking", "users", "display", "nullable -> NOT NULL"),
        ("benign", "users", "email", "nullable -> NOT NULL")}


def test_tables_keys_references_enums(spark):
    live = replace(USERS, primary_key=("id", "org_id"), unique=(UniqueKey(("email",), "id > 0"),),
                   foreign_keys=(ForeignKey(("org_id",), "teams", ("id",)), ForeignKey(("id",), "orgs", ("id",))))
    got = drift(spark, SchemaSpec.of(live, TableSpec("teams", (int_col("id"),), ("id",)),
                                     enums={"tier": ("free", "max")}))
    assert got == {
        ("needs confirmation", "orgs", None, "table dropped"),
        ("benign", "teams", None, "table added"),
        ("breaking", "users", None, "primary key (id) -> (id, org_id)"),
        ("breaking", "users", "org_id", "nullable -> NOT NULL"),
        ("breaking", "users", None, "unique constraint dropped on (email)"),
        ("benign", "users", None, "unique constraint added on (email) where id > 0"),
        ("breaking", "users", None, "foreign key on (org_id) retargeted: orgs(id) -> teams(id)"),
        ("breaking", "users", None, "foreign key added on (id) -> orgs(id)"),
        ("breaking", "users", None, 'enum tier: label "pro" removed'),
        ("benign", "users", None, 'enum tier: label "max" added'),
    }
    gone = drift(spark, SchemaSpec.of(USERS, enums=BASE.enums), creatable=True)
    assert gone == {("benign", "orgs", None, "not in the target yet")}


def test_enum_by_labels_and_dropped(spark):
    live = SchemaSpec.of(ORGS, changed(plan=ColumnSpec("plan", "enum", type_name="users.plan")),
                         enums={"users.plan": ("pro", "free")})
    assert drift(spark, live) == set()
    live = SchemaSpec.of(ORGS, changed(plan=text_col("plan")))
    assert drift(spark, live) == {("benign", "users", "plan", "enum tier -> text"),
                                  ("breaking", "users", None, "enum type tier dropped")}


@pytest.mark.parametrize("a,b,ok", [
    (int_col("x", 32), int_col("x", 16), False), (int_col("x", 64), ColumnSpec("x", "decimal", precision=3, scale=1), True),
    (int_col("x", 16), ColumnSpec("x", "float", bits=32), True), (int_col("x", 64), ColumnSpec("x", "float", bits=64), False),
    (ColumnSpec("x", "uuid"), text_col("x", 36), True), (ColumnSpec("x", "uuid"), text_col("x", 35), False),
    (ColumnSpec("x", "date"), ColumnSpec("x", "timestamp", tz=True), True),
    (ColumnSpec("x", "timestamp", tz=True), ColumnSpec("x", "timestamp"), False),
    (ColumnSpec("x", "json"), ColumnSpec("x", "json", binary=True), True),
    (ColumnSpec("x", "bytes"), text_col("x"), True), (text_col("x"), int_col("x"), False),
    (ColumnSpec("x", "decimal", precision=10, scale=2), ColumnSpec("x", "decimal"), True),
])
def test_widening(spark, a, b, ok):
    rec, live = (SchemaSpec.of(TableSpec("t", (c,))) for c in (a, b))
    got = drift(spark, live, rec)
    assert (not any(s == "breaking" for s, *_ in got)) is ok and callable(widens)


def test_policy_and_acceptance(spark):
    live = SchemaSpec.of(ORGS, changed(display=None, email=text_col("email", 10)), enums=BASE.enums)
    found = schema_drift(catalog(spark, BASE), catalog(spark, live))
    with pytest.raises(DriftBlocked, match="display"):
        gate(found, [])
    gate(found, [], confirmed=True)
    gate(found, [SliceSpec("users", on_drift="ignore")])
    with pytest.raises(DriftBlocked):
        gate(found, [SliceSpec("users", on_drift="abort")], confirmed=True)
    none = spark.createDataFrame([], "scope string, change string")
    one = found.filter("column = 'display'").select(F.col("table").alias("scope"), change_text().alias("change"))
    kept = accept(none, one)
    assert [r["column"] for r in drop_accepted(found, kept).collect()] == ["email"]
    all_of = accept(kept, spark.createDataFrame([("users", "*")], "scope string, change string"))
    assert all_of.count() == 1 and drop_accepted(found, all_of).isEmpty()
    assert carry_accepted(kept, ["users"]).isEmpty() and carry_accepted(all_of, ["users"]).count() == 1
    assert [r["column"] for r in drift_report(found).collect()] == ["display", "email"]
    assert {r["severity"]: r["n"] for r in drift_counts(found).collect()} == {"needs confirmation": 2}


def test_bucket_rules(spark):
    cols = "bucket string, public boolean, size_limit long, mime_types array<string>"
    rec = spark.createDataFrame([("a", True, 100, None), ("b", True, None, ["x"]), ("gone", False, None, None)], cols)
    live = spark.createDataFrame([("a", False, 40, None), ("b", True, 60, ["y"]), ("new", False, None, None)], cols)
    largest = spark.createDataFrame([("a", 50), ("b", 50)], "bucket string, largest long")
    got = {(r["severity"], r["bucket"], r["what"]) for r in bucket_drift(rec, live, largest).collect()}
    assert got == {
        ("breaking", "gone", "bucket does not exist"), ("benign", "new", "bucket added"),
        ("breaking", "a", "file size limit 40 is below the largest exported object (50 bytes)"),
        ("benign", "a", "public true -> false"), ("benign", "b", "file size limit lowered to 60"),
        ("benign", "b", "allowed mime types [x] -> [y]")}


# --- graphs ---


def fk(*pairs, deferrable=False):
    names = {n for p in pairs for n in p}
    return SchemaSpec.of(*[
        TableSpec(n, (int_col("id"), *[int_col(f"{p}_id") for c, p in pairs if c == n]), ("id",), (),
                  tuple(ForeignKey((f"{p}_id",), p, ("id",), deferrable) for c, p in pairs if c == n))
        for n in sorted(names)])


def test_load_order_and_levels(spark):
    diamond = fk(("left", "top"), ("right", "top"), ("bottom", "left"), ("bottom", "right"), ("top", "top"))
    order = load_order(diamond, diamond.tables)
    assert order.tables == ["top", "left", "right", "bottom"] and order.cyclic == []
    assert order.reversed()[0] == "bottom"
    assert load_order(diamond, ["bottom", "right"]).tables == ["right", "bottom"]
    levels = dependency_levels(fk_edges(spark, diamond)).collect()
    assert {r["node"]: r["level"] for r in levels} == {"top": 0, "left": 1, "right": 1, "bottom": 2}


@pytest.mark.parametrize("deferrable", [True, False])
def test_cycles(spark, deferrable):
    schema = fk(("a", "b"), ("b", "a"), ("c", "a"), ("b", "d"), deferrable=deferrable)
    order = load_order(schema, schema.tables)
    assert order.tables == ["d", "a", "b", "c"] and order.cyclic == ["a", "b", "c"]
    assert order.all_deferrable is deferrable
    members = cycle_members(fk_edges(spark, schema)).collect()
    assert {(r["node"], r["all_deferrable"]) for r in members} == {("a", deferrable), ("b", deferrable)}
    levels = {r["node"]: r["level"] for r in dependency_levels(fk_edges(spark, schema)).collect()}
    assert levels == {"d": 0, "a": None, "b": None, "c": None}


def test_reachability(spark):
    edges = fk_edges(spark, fk(("b", "a"), ("c", "b"), ("d", "c"), ("d", "x"), ("a", "a")))
    b = spark.createDataFrame([("b",)], "node string")
    assert {r["node"]: r["distance"] for r in reachable(edges, b, "children").collect()} == {"b": 0, "c": 1, "d": 2}
    assert {r["node"] for r in reachable(edges, b, "children", depth=1).collect()} == {"b", "c"}
    why = relatives(edges, b, with_children=True)
    assert {r["node"]: r["why"] for r in why.collect()} == {
        "b": "named", "c": "child(1)", "d": "child(2)", "a": "parent", "x": "parent"}


# --- documents ---


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("doc"))


def test_profile(spark):
    df = docs(spark, '{"_id":{"$oid":"65a0"},"score":1}', '{"_id":{"$oid":"65a1"},"score":"x","n":null}', '{}')
    got = {r["name"]: r for r in profile_flags(profile_fields(df)).withColumn("cls", field_class(F.col("types"))).collect()}
    assert got["score"]["types"] == ["int", "string"] and got["score"]["present"] == 2
    assert got["score"]["sampled"] == 3 and got["score"]["polymorphic"] and got["score"]["cls"] == "jsonb"
    assert got["_id"]["types"] == ["objectId"] and not got["_id"]["always_present"]
    spec = profile_spec("users", profile_fields(df))
    assert spec.column_names == ["_id", "n", "score"] and spec.column("score").has_default
    assert class_for(["long", "null"], "x").label() == "int64"


def test_contract(spark):
    spec = contract_spec("users", {
        "required": ["email", "plan"],
        "properties": {"plan": {"enum": ["free", "pro"]}, "email": {"bsonType": "string"},
                       "nick": {"bsonType": ["string", "null"]}}})
    assert spec.column_names == ["_id", "email", "nick", "plan"]
    df = docs(spark, '{"_id":{"$oid":"a"},"email":"e","plan":"free"}', '{"_id":{"$oid":"b"},"plan":"gold"}')
    got = {(r["rule"], r["column"], r["key"]) for r in check_rows(documents_to_table(df, spec), spec).collect()}
    assert got == {("not_null", "email", "b"), ("enum_label", "plan", "b")}


def test_documents_round_trip(spark):
    spec = TableSpec("d", (
        ColumnSpec("_id", "other", type_name="objectId"), int_col("n"), int_col("i", 32),
        ColumnSpec("d", "decimal", precision=34), ColumnSpec("b", "bytes"), ColumnSpec("u", "uuid"),
        ColumnSpec("at", "timestamp", tz=True), ColumnSpec("f", "float"), ColumnSpec("t", "bool"),
        ColumnSpec("j", "json"), text_col("s"), ColumnSpec("r", "other", type_name="regex"),
        ColumnSpec("ts", "other", type_name="timestamp")), ("_id",))
    text = (
        '{"_id":{"$oid":"65a0"},"n":{"$numberLong":"7"},"i":3,"d":{"$numberDecimal":"19.9900"},'
        '"b":{"$binary":{"base64":"3q0=","subType":"00"}},'
        '"u":{"$binary":{"base64":"oO68mZwLTvi7bWu5vTgKEQ==","subType":"04"}},'
        '"at":{"$date":"2024-01-01T00:00:00Z"},"f":0.5,"t":true,"j":{"a":[1]},"s":"q\\"q",'
        '"r":{"$regularExpression":{"pattern":"a/b","options":"i"}},"ts":{"$timestamp":{"t":5,"i":1}}}')
    table = documents_to_table(docs(spark, text, '{"_id":{"$oid":"65a1"}}'), spec).orderBy("_id")
    row = table.first()
    assert (row["n"], row["b"], row["u"], row["r"], row["ts"]) == (
        7, bytearray(b"\xde\xad"), "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "/a/b/i", "5:1")
    back = [r["value"] for r in table_to_documents(table, spec).collect()]
    assert back == [text.replace("19.9900", str(row["d"])), '{"_id":{"$oid":"65a1"}}']


def test_filter_document(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "b", None)], "id int, s string, n int")

    def ids(rule):
        return [r["id"] for r in df.filter(filter_document(rule)).orderBy("id").collect()]

    assert ids('{"s": {"$ne": "a"}}') == [2, 3]
    assert ids({"s": None}) == [2] and ids({"s": {"$exists": True}, "n": {"$lte": 5}}) == [1]
    assert ids({"$or": [{"n": {"$gt": 6}}, {"s": {"$in": ["b", None]}}]}) == [2, 3]
    assert ids({"s": {"$nin": ["a"]}}) == [2, 3] and ids({"n": {"$not": {"$gte": 6}}}) == [1, 3]
    assert ids({"$nor": [{"s": "a"}, {"n": 7}]}) == [3] and ids({}) == [1, 2, 3]
    for bad in ("[1]", {"s": {"$regex": "x"}}, {"$where": 1}):
        with pytest.raises(SpecError):
            filter_document(bad)
