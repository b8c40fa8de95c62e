"""Staged loads: what is refused, and what is left in place."""

import pytest
from pyspark.sql import functions as F

from tableslice import SchemaSpec, SliceSpec, TableSpec
from tableslice.errors import DriftBlocked, MergeConflict, ReadOnlyTarget, SpecError
from tableslice.operators.drift import catalog, schema_drift
from tableslice.operators.merge import merge_documents, merge_upsert
from tableslice.plans.load import RECORD, cut_slice, export_slice, load, verify_export
from tableslice.session import cut, ensure_checkpoint_dir, working_files
from tableslice.sources.commit import commit_tables, committed, publish, read_committed, stage_tables
from tableslice.sources.files import read_csv, read_jsonl, read_objects
from tableslice.spec import ColumnSpec, ForeignKey, UniqueKey, int_col, text_col

USERS = TableSpec(
    "users",
    (int_col("id"), text_col("email", nullable=False), text_col("must", nullable=False),
     text_col("plan", nullable=False, default="'free'"), text_col("email_lower", computed="lower(email)"), int_col("boss")),
    ("id",), unique=(UniqueKey(("email",)),), foreign_keys=(ForeignKey(("boss",), "users", ("id",)),),
)
SCHEMA = SchemaSpec.of(USERS)
TYPES = "id bigint, email string, must string, plan string, email_lower string, boss bigint"


@pytest.fixture
def target(spark, tmp_path):
    users = spark.createDataFrame([(1, "A@x", "m", "pro", "a@x", None), (2, "b@x", "m", "free", "b@x", 1)], TYPES)
    commit_tables({"users": users}, str(tmp_path))
    return str(tmp_path), {"users": read_committed(spark, str(tmp_path), "users")}


def try_load(spark, target, rows, types, **options):
    root, tables = target
    seed = spark.createDataFrame(rows, types)
    return load(tables, {"users": seed}, SCHEMA, [SliceSpec("users", **options)], root)


@pytest.mark.parametrize("rows, types, said", [
    ([(1, "b@x")], "id bigint, email string", "unique on email"),
    ([(3, "c@x")], "id bigint, email string", "not_null on must"),
    ([(3, "c@x", "m", None)], "id bigint, email string, must string, plan string", "not_null on plan"),
    ([(3, "c@x", "m", 9)], "id bigint, email string, must string, boss bigint", "without a parent"),
    ([(1, "q@x"), (1, "r@x")], "id bigint, email string", "duplicate_key"),
])
def test_refused_loads_leave_the_old_commit(spark, target, rows, types, said):
    before = committed(spark, target[0])
    with pytest.raises(MergeConflict, match=said):
        try_load(spark, target, rows, types)
    assert committed(spark, target[0]) == before
    assert sorted(p.name for p in __import__("pathlib").Path(target[0], "_data").iterdir()) == [
        before["users"].split("/")[-2]]


def test_load_fills_defaults_and_recomputes(spark, target):
    done = try_load(spark, target, [(1, "C@X", "m"), (7, "New@x", "n")], "id bigint, email string, must string")
    got = {r.id: (r.email, r.plan, r.email_lower, r.boss) for r in read_committed(spark, target[0], "users").collect()}
    assert got == {1: ("C@X", "pro", "c@x", None), 2: ("b@x", "free", "b@x", 1), 7: ("New@x", "free", "new@x", None)}
    assert [tuple(r) for r in done.results.collect()] == [("users", "upsert", 2, 2, 0)]


def test_many_findings_are_counted(spark, target):
    rows = [(i, f"{i}@x", None) for i in range(10, 40)]
    with pytest.raises(MergeConflict, match="and 10 more"):
        try_load(spark, target, rows, "id bigint, email string, must string")


@pytest.mark.parametrize("threshold", ["-1", "1", "10485760"])
def test_one_plan_at_every_size(spark, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        spec = TableSpec("t", (int_col("k", 32), text_col("v")), ("k",))
        target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        seed = spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string")
        out = merge_upsert(target, seed, spec)
        assert out.dtypes == target.dtypes
        assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "B"), (3, "C")]
    finally:
        spark.conf.set(key, old)


def test_partial_key_repeats_inside_its_predicate(spark, tmp_path):
    docs = TableSpec("docs", (int_col("id"), text_col("slug"), text_col("gone")),
                     unique=(UniqueKey(("slug",), "gone IS NULL"),))
    empty = spark.createDataFrame([], "id bigint, slug string, gone string")
    twice = spark.createDataFrame([(1, "a", None), (2, "a", None)], empty.schema)
    with pytest.raises(MergeConflict, match="duplicate_key on slug"):
        load({"docs": empty}, {"docs": twice}, SchemaSpec.of(docs), [SliceSpec("docs")], str(tmp_path))
    fine = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", "y")], empty.schema)
    load({"docs": empty}, {"docs": fine}, SchemaSpec.of(docs), [SliceSpec("docs")], str(tmp_path))
    assert read_committed(spark, str(tmp_path), "docs").count() == 3


def test_export_with_record(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a@x", "m", "p", "a@x", None), (2, "b@x", "m", "p", "b@x", 1)], TYPES)
    export = cut_slice({"users": rows}, SCHEMA, [SliceSpec("users")])
    export_slice(export, root, schema=SCHEMA)
    assert set(committed(spark, root)) == {"users", RECORD}
    assert verify_export(spark, root, SCHEMA).collect() == []
    dangling = cut_slice({"users": rows.filter("id = 2")}, SCHEMA, [SliceSpec("users")])
    with pytest.raises(MergeConflict, match="without a parent"):
        export_slice(dangling, root, schema=SCHEMA)
    assert verify_export(spark, root, SCHEMA).collect() == []


def test_drift_stops_before_reading(spark, target):
    new = SchemaSpec.of(TableSpec("users", (int_col("id"), text_col("must", nullable=False)), ("id",)))
    drift = schema_drift(catalog(spark, new), catalog(spark, SCHEMA))
    with pytest.raises(DriftBlocked):
        load({}, {}, SCHEMA, [SliceSpec("users", on_drift="abort")], target[0], drift=drift)
    with pytest.raises(DriftBlocked):
        cut_slice({}, SCHEMA, [SliceSpec("users", on_drift="abort")], drift=drift)


def test_two_writers(spark, tmp_path):
    root = str(tmp_path)
    one = spark.range(3).toDF("id")
    commit_tables({"t": one}, root)
    (tmp_path / "_commits" / f"{2:020d}").write_text("")  # another writer has begun
    assert read_committed(spark, root, "t").count() == 3
    staged = stage_tables({"t": one.limit(1)}, root)
    publish(spark, root, staged)
    assert read_committed(spark, root, "t").count() == 1
    with pytest.raises(ReadOnlyTarget):
        commit_tables({"t": one}, root, read_only=True)


def test_repeated_documents(spark):
    old = spark.createDataFrame([(1, "old")], "_id bigint, v string")
    seed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "_id bigint, v string").coalesce(1)
    assert sorted(tuple(r) for r in merge_documents(old, seed, "replace").collect()) == [(1, "b"), (2, "d")]
    assert sorted(tuple(r) for r in merge_documents(old, seed, "set_on_insert").collect()) == [(1, "old"), (2, "c")]
    with pytest.raises(MergeConflict, match="given twice"):
        merge_documents(old, seed, "insert")


def test_readers_refuse_what_does_not_parse(spark, tmp_path):
    spec = TableSpec("t", (int_col("id"), ColumnSpec("j", "json"), text_col("s")), ("id",))
    (tmp_path / "good").write_text('{"id":1,"j":{"a":1,"a":2},"s":"x"}\n')
    assert [r.id for r in read_jsonl(spark, str(tmp_path / "good"), spec).collect()] == [1]
    (tmp_path / "bad").write_text('{"id":"abc","s":"x"}\n')
    with pytest.raises(Exception, match="table t, column id: no int64: abc"):
        read_jsonl(spark, str(tmp_path / "bad"), spec).collect()
    (tmp_path / "bad.csv").write_text("id,s\n1.5,x\n")
    with pytest.raises(Exception, match="column id"):
        read_csv(spark, str(tmp_path / "bad.csv"), spec).collect()
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "small").write_bytes(b"x" * 10)
    (tmp_path / "o" / "large").write_bytes(b"x" * 100)
    with pytest.raises(SpecError, match="large"):
        read_objects(spark, str(tmp_path / "o"), max_bytes=50)
    assert read_objects(spark, str(tmp_path / "o"), max_bytes=100).count() == 2


def test_working_files_are_removed(spark):
    from pathlib import Path

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    with working_files(spark):
        assert cut(spark.range(5)).agg(F.sum("id")).first()[0] == 10
        assert len(set(folder.glob("cut-*")) - before) == 1
    assert set(folder.glob("cut-*")) == before
