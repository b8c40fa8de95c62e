import pytest
from pyspark.sql import functions as F

from tableslice.errors import ClosureNotSettled, MergeConflict, ReadOnlyTarget, SpecError
from tableslice.operators.checks import check_rows, unique_violations
from tableslice.operators.counts import next_identity, status
from tableslice.operators.diff import row_diff
from tableslice.operators.merge import (
    merge_documents, merge_insert, merge_skip_existing, merge_tables, merge_upsert,
)
from tableslice.operators.refs import check_references, follow_parents
from tableslice.plans.load import cut_slice, export_slice, load
from tableslice.sources.commit import commit_tables, committed, prune_stale, read_committed
from tableslice.sources.tables import Source, TableSet
from tableslice.spec import (
    ColumnSpec, ForeignKey, SchemaSpec, SliceSpec, TableSpec, UniqueKey, int_col, text_col,
)

ORGS = TableSpec("orgs", (int_col("id"), text_col("name", 80)), ("id",), (UniqueKey(("name",)),))
USERS = TableSpec("users", (int_col("id"), int_col("org_id"), text_col("email")), ("id",),
                  foreign_keys=(ForeignKey(("org_id",), "orgs", ("id",)),))
ORDERS = TableSpec("orders", (int_col("id"), int_col("user_id")), ("id",),
                   foreign_keys=(ForeignKey(("user_id",), "users", ("id",)),))
EMPLOYEES = TableSpec("employees", (int_col("id"), int_col("manager_id"), text_col("name")), ("id",),
                      foreign_keys=(ForeignKey(("manager_id",), "employees", ("id",)),))
SCHEMA = SchemaSpec.of(ORGS, USERS, ORDERS, EMPLOYEES)


@pytest.fixture
def data(spark):
    return {
        "orgs": spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, name string"),
        "users": spark.createDataFrame(
            [(10, 1, "a"), (11, 1, "b"), (12, 2, "c"), (13, None, "d")],
            "id long, org_id long, email string"),
        "orders": spark.createDataFrame([(100, 10), (101, 12), (102, 12)], "id long, user_id long"),
        "employees": spark.createDataFrame(
            [(1, None, "ceo"), (2, 1, "vp"), (3, 2, "lead"), (4, 3, "dev")],
            "id long, manager_id long, name string"),
    }


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_orphans_are_reported(data):
    tables = {"orgs": data["orgs"].filter("id = 3"), "users": data["users"], "orders": data["orders"]}
    got = {r["child"]: r for r in check_references(tables, SCHEMA).collect()}
    assert list(got) == ["users"]
    assert got["users"]["missing"] == 2 and got["users"]["examples"] == ["1", "2"]
    del tables["orgs"]
    row = check_references(tables, SCHEMA).first()
    assert row["parent_in_slice"] is False and row["missing"] == 2


def test_self_reference_looks_at_own_rows(data):
    got = check_references({"employees": data["employees"].filter("id > 2")}, SCHEMA).first()
    assert (got["missing"], got["examples"], got["parent_in_slice"]) == (1, ["2"], True)


def test_composite_reference_ignores_partial_nulls(spark):
    parent = TableSpec("p", (int_col("a"), int_col("b")), ("a", "b"))
    child = TableSpec("c", (int_col("a"), int_col("b")), (), (), (ForeignKey(("a", "b"), "p", ("a", "b")),))
    tables = {
        "p": spark.createDataFrame([(1, 1)], "a long, b long"),
        "c": spark.createDataFrame([(1, 1), (1, None), (None, None), (1, 2)], "a long, b long"),
    }
    got = check_references(tables, SchemaSpec.of(parent, child)).first()
    assert (got["missing"], got["examples"]) == (1, ["1, 2"])


def test_parents_and_grandparents_are_pulled(data):
    slices = [SliceSpec("orders"), SliceSpec("users", where="1 = 0"), SliceSpec("orgs", where="id = 99")]
    closed = follow_parents(data, SCHEMA, slices)
    assert ids(closed.tables["users"]) == [10, 12] and ids(closed.tables["orgs"]) == [1, 2]
    assert closed.rounds == 2
    assert check_references(closed.tables, SCHEMA).isEmpty()
    report = {r["table"]: (r["rows"], r["pulled"]) for r in closed.report().collect()}
    assert report == {"orders": (3, 0), "users": (2, 2), "orgs": (2, 2)}


def test_limit_keeps_its_rows_and_gains_others(data):
    slices = [SliceSpec("orgs", order_by=("name",), limit=1), SliceSpec("users")]
    closed = follow_parents(data, SCHEMA, slices)
    assert ids(closed.tables["orgs"]) == [1, 2]  # "one" by limit, "two" by reference


def test_self_reference_closure_and_depth(data):
    slices = [SliceSpec("employees", where="id = 4")]
    closed = follow_parents(data, SCHEMA, slices)
    assert ids(closed.tables["employees"]) == [1, 2, 3, 4] and closed.rounds == 3
    with pytest.raises(ClosureNotSettled, match="employees"):
        follow_parents(data, SCHEMA, slices, max_depth=2)


def test_key_without_a_parent_row_is_left_dangling(data):
    data["users"] = data["users"].withColumn("org_id", F.when(F.col("id") == 10, 77).otherwise(F.col("org_id")))
    closed = follow_parents(data, SCHEMA, [SliceSpec("users"), SliceSpec("orgs", where="false")])
    got = check_references(closed.tables, SCHEMA).collect()
    assert [(r["missing"], r["examples"]) for r in got] == [(1, ["77"])]


def test_reference_to_a_unique_column(spark):
    parent = TableSpec("p", (int_col("id"), text_col("code")), ("id",), (UniqueKey(("code",)),))
    child = TableSpec("c", (int_col("id"), int_col("pid"), text_col("code")), ("id",), (), (
        ForeignKey(("code",), "p", ("code",)), ForeignKey(("pid",), "p", ("id",))))
    tables = {
        "p": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, code string"),
        "c": spark.createDataFrame([(1, 2, "y"), (2, 3, "x")], "id long, pid long, code string"),
    }
    closed = follow_parents(tables, SchemaSpec.of(parent, child),
                            [SliceSpec("c"), SliceSpec("p", where="false")])
    assert ids(closed.tables["p"]) == [1, 2, 3]  # row 2 is asked for twice, taken once


def test_parents_not_listed(data):
    slices = [SliceSpec("users", where="id = 10")]
    assert "orgs" not in follow_parents(data, SCHEMA, slices).tables
    assert ids(follow_parents(data, SCHEMA, slices, add_missing_parents=True).tables["orgs"]) == [1]


# --- merges ---


def test_upsert_twice_is_upsert_once(spark, data):
    seed = spark.createDataFrame([(1, "ONE"), (9, "nine")], "id long, name string")
    once = merge_upsert(data["orgs"], seed, ORGS)
    assert sorted((r["id"], r["name"]) for r in once.collect()) == [
        (1, "ONE"), (2, "two"), (3, "three"), (9, "nine")]
    assert merge_upsert(once, seed, ORGS).exceptAll(once).isEmpty()
    again = row_diff(seed, once, ORGS)
    assert {r["change"] for r in again.collect()} == {"unchanged"}


def test_upsert_keeps_columns_the_seed_lacks_and_writes_nulls(spark, data):
    seed = spark.createDataFrame([(10, None)], "id long, org_id long")
    got = {r["id"]: r for r in merge_upsert(data["users"], seed, USERS).collect()}
    assert got[10]["org_id"] is None and got[10]["email"] == "a"


def test_key_only_upsert_ensures_presence(spark):
    spec = TableSpec("k", (int_col("id"),), ("id",))
    got = merge_upsert(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long"), spec)
    assert ids(got) == [1, 2]


def test_partial_key(spark):
    spec = TableSpec("docs", (int_col("id"), text_col("tenant"), text_col("slug"), text_col("title"),
                              text_col("deleted")), (), (UniqueKey(("tenant", "slug"), "deleted IS NULL"),))
    cols = "id long, tenant string, slug string, title string, deleted string"
    target = spark.createDataFrame([(1, "acme", "intro", "old", None), (2, "acme", "intro", "gone", "x")], cols)
    seed = spark.createDataFrame([(1, "acme", "intro", "new", None), (3, "acme", "intro", "also gone", "y")], cols)
    got = sorted((r["id"], r["title"]) for r in merge_upsert(target, seed, spec).collect())
    assert got == [(1, "new"), (2, "gone"), (3, "also gone")]
    assert unique_violations(merge_upsert(target, seed, spec), spec).isEmpty()


def test_null_keys_never_conflict(spark):
    spec = TableSpec("n", (int_col("k"), text_col("v")), (), (UniqueKey(("k",)),))
    target = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    seed = spark.createDataFrame([(None, "c"), (1, "d")], "k long, v string")
    assert sorted(r["v"] for r in merge_upsert(target, seed, spec).collect()) == ["a", "c", "d"]


def test_insert_conflict_aborts(spark, data):
    with pytest.raises(MergeConflict, match="already exist"):
        merge_insert(data["orgs"], spark.createDataFrame([(1, "x")], "id long, name string"), ORGS)
    with pytest.raises(MergeConflict, match=r"\(name\)"):
        merge_insert(data["orgs"], spark.createDataFrame([(7, "two")], "id long, name string"), ORGS)
    with pytest.raises(MergeConflict, match="twice"):
        merge_insert(data["orgs"], spark.createDataFrame([(7, "x"), (7, "y")], "id long, name string"), ORGS)


def brute_skip(target, seed, keys):
    held = [{tuple(r[k] for k in key) for r in target} for key in keys]
    out = []
    for row in sorted(seed, key=lambda r: tuple((v is None, v) for v in r.values())):
        marks = [tuple(row[k] for k in key) for key in keys]
        if any(None not in m and m in h for m, h in zip(marks, held)):
            continue
        out.append(row)
        for m, h in zip(marks, held):
            h.add(m)
    return out


def test_skip_existing_under_several_constraints(spark):
    import random

    rnd = random.Random(3)
    spec = TableSpec("t", (int_col("id"), int_col("a"), int_col("b")), ("id",),
                     (UniqueKey(("a",)), UniqueKey(("b",))))
    target = [dict(id=i, a=100 + i, b=200 + i) for i in range(5)]
    seed = [dict(id=rnd.randint(0, 40), a=rnd.choice([None, *range(30), 102]),
                 b=rnd.choice([None, *range(25), 203])) for _ in range(60)]
    t = spark.createDataFrame([tuple(r.values()) for r in target], "id long, a long, b long")
    s = spark.createDataFrame([tuple(r.values()) for r in seed], "id long, a long, b long")
    want = target + brute_skip(target, seed, [("id",), ("a",), ("b",)])
    got = [r.asDict() for r in merge_skip_existing(t, s, spec).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_document_modes(spark):
    old = spark.createDataFrame([(1, "x", 5)], "_id long, k string, n int")
    seed = spark.createDataFrame([(1, "y"), (2, "z")], "_id long, k string")
    got = {r["_id"]: (r["k"], r["n"]) for r in merge_documents(old, seed, "replace").collect()}
    assert got == {1: ("y", None), 2: ("z", None)}
    got = {r["_id"]: (r["k"], r["n"]) for r in merge_documents(old, seed, "set_on_insert").collect()}
    assert got == {1: ("x", 5), 2: ("z", None)}
    with pytest.raises(MergeConflict):
        merge_documents(old, seed, "insert")


def test_no_key(spark, data):
    spec = TableSpec("orgs", ORGS.columns)
    assert row_diff(data["orgs"], data["orgs"], spec) is None
    with pytest.raises(SpecError, match="no key"):
        merge_upsert(data["orgs"], data["orgs"], spec)


def test_cyclic_tables_merge_and_are_checked_after(spark):
    a = TableSpec("a", (int_col("id"), int_col("b_id")), ("id",), (), (ForeignKey(("b_id",), "b", ("id",)),))
    b = TableSpec("b", (int_col("id"), int_col("a_id")), ("id",), (), (ForeignKey(("a_id",), "a", ("id",)),))
    empty = {"a": spark.createDataFrame([], "id long, b_id long"), "b": spark.createDataFrame([], "id long, a_id long")}
    seeds = {"a": spark.createDataFrame([(1, 2)], "id long, b_id long"),
             "b": spark.createDataFrame([(2, 1)], "id long, a_id long")}
    out = merge_tables(empty, seeds, SchemaSpec.of(a, b), {n: SliceSpec(n) for n in seeds})
    assert out.dangling.isEmpty()


# --- diffs and whole loads ---


def test_diff_names_the_changed_column(spark, data):
    seed = spark.createDataFrame([(1, "ONE"), (2, "two"), (8, "new")], "id long, name string")
    got = {r["key"][0]: r for r in row_diff(seed, data["orgs"], ORGS, SliceSpec("orgs", load="truncate_first")).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"1": "updated", "2": "unchanged", "8": "added", "3": "removed"}
    assert [tuple(c) for c in got["1"]["changes"]] == [("name", "one", "ONE")]


def test_diff_reads_json_by_content(spark):
    spec = TableSpec("t", (int_col("id"), ColumnSpec("j", "json")), ("id",))
    a = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1.50}')], "id long, j string")
    b = spark.createDataFrame([(1, '{"b": 2, "a": 1}'), (2, '{"a":1.5}')], "id long, j string")
    assert {r["key"][0]: r["change"] for r in row_diff(a, b, spec).collect()} == {"1": "unchanged", "2": "updated"}


def test_load_is_all_or_nothing(spark, data, tmp_path):
    root = str(tmp_path / "target")
    commit_tables({n: data[n] for n in ("orgs", "users")}, root)
    targets = {n: read_committed(spark, root, n) for n in ("orgs", "users")}
    schema = SchemaSpec.of(ORGS, USERS)
    slices = [SliceSpec("users"), SliceSpec("orgs")]
    bad = {"orgs": spark.createDataFrame([(5, "five")], "id long, name string"),
           "users": spark.createDataFrame([(20, 99, "z")], "id long, org_id long, email string")}
    before = committed(spark, root)
    with pytest.raises(MergeConflict, match="99"):
        load(targets, bad, schema, slices, root)
    assert committed(spark, root) == before and read_committed(spark, root, "orgs").count() == 3

    good = dict(bad, users=bad["users"].withColumn("org_id", F.lit(5).cast("long")))
    dry = load(targets, good, schema, slices, root, dry_run=True)
    assert {r["table"]: r["added"] for r in dry.changes.collect()} == {"orgs": 1, "users": 1}
    assert committed(spark, root) == before
    done = load(targets, good, schema, slices, root)
    assert [r["table"] for r in done.plan.orderBy("position").collect()] == ["orgs", "users"]
    assert read_committed(spark, root, "users").count() == 5
    assert {r["table"]: r["affected"] for r in done.results.collect()} == {"orgs": 1, "users": 1}
    assert len(prune_stale(spark, root)) == 2 and read_committed(spark, root, "orgs").count() == 4
    with pytest.raises(ReadOnlyTarget):
        load(targets, good, schema, slices, root, read_only=True)
    with pytest.raises(MergeConflict, match="empty orgs"):
        load(targets, good, schema, [SliceSpec("orgs", load="truncate_first")], root)
    twice = {"orgs": good["orgs"].unionByName(good["orgs"])}
    with pytest.raises(MergeConflict, match="duplicate_key"):
        load(targets, twice, schema, [SliceSpec("orgs")], root)


def test_export_refuses_dangling_references(spark, data, tmp_path):
    slices = [SliceSpec("users"), SliceSpec("orgs", where="id = 1")]
    cut = cut_slice(data, SCHEMA, slices)
    with pytest.raises(MergeConflict, match="users"):
        export_slice(cut, str(tmp_path / "a"))
    closed = cut_slice(data, SCHEMA, slices, with_parents=True)
    paths = export_slice(closed, str(tmp_path / "b"))
    assert spark.read.parquet(paths["orgs"]).count() == 2


def test_checks(spark):
    spec = TableSpec("t", (int_col("id"), text_col("s", 2, nullable=False)), ("id",))
    df = spark.createDataFrame([(1, "ok"), (1, "é🎉"), (2, "abc"), (3, None)], "id long, s string")
    got = {(r["rule"], r["key"]) for r in check_rows(df, spec).collect()}
    assert got == {("duplicate_key", "1"), ("max_length", "2"), ("not_null", "3")}


def test_status_and_identity(spark, data):
    live = spark.createDataFrame([("a", 3), ("b", 1)], "table string, rows long")
    rec = spark.createDataFrame([("a", 3), ("c", 1)], "table string, rows long")
    assert {r["table"]: r["note"] for r in status(rec, live).collect()} == {
        "a": "in sync", "b": "not exported, live 1", "c": "seeded 1, live unknown"}
    assert next_identity(data["orgs"], "id").first()["next"] == 4
    assert next_identity(data["orgs"].limit(0), "id").first()["next"] == 1


def test_sources(spark, data):
    sources = TableSet(spark, {"main": lambda s, n: data[n], "ro": Source(lambda s, n: data[n], read_only=True)}, "main")
    assert sources.read("orgs").count() == 3
    with pytest.raises(ReadOnlyTarget):
        sources.check_writable("ro")
    with pytest.raises(SpecError, match="did you mean 'main'"):
        sources.read("orgs", "mains")


def test_a_large_upsert_holds_no_side_whole(spark, monkeypatch):
    """The target's keys, small as a file, used to be broadcast to every task."""
    from tableslice.operators import merge
    from tableslice.spec import TableSpec, int_col

    spec = TableSpec("t", (int_col("k"), int_col("x"), int_col("y")), ("k",))
    target = spark.range(300).selectExpr("id AS k", "id AS x", "id AS y")
    seed = spark.range(200, 400).selectExpr("id AS k", "-id AS x")
    want = {(k, -k if k >= 200 else k, k if k < 300 else None) for k in range(400)}
    small = merge.merge_upsert(target, seed, spec)
    monkeypatch.setattr(merge, "ROWS_TOGETHER", 100)
    large = merge.merge_upsert(target, seed, spec)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} == want
    assert small.count() == large.count() == 400
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(k" in plan
