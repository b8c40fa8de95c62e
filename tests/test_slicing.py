import pytest
from pyspark.sql import functions as F

from tableslice.errors import SpecError
from tableslice.operators.checks import duplicate_rows, indexed_violations, row_violations
from tableslice.operators.digest import table_digest
from tableslice.operators.rowindex import rank_in_group, row_index
from tableslice.operators.slicing import align_to_spec, cut_table, key_filter, order_columns
from tableslice.spec import (
    ColumnSpec, SchemaSpec, SliceSpec, TableSpec, UniqueKey, align_column_order, int_col, merge_key,
    restrict, select_tables, selected_columns, spec_from_schema, text_col, to_struct, ForeignKey,
)

USERS = TableSpec("users", (
    int_col("id"), text_col("email", 10), ColumnSpec("prefs", "json"), text_col("name"),
    text_col("email_lower", generated=True)), ("id",), (UniqueKey(("email",)),))


def users(spark):
    return spark.createDataFrame(
        [(3, "b@x", None, "Zoe", "b@x"), (1, "a@x", "{}", "Ann", "a@x"), (2, None, None, None, None),
         (4, "c@x", "[]", "ann", "c@x")],
        "id long, email string, prefs string, name string, email_lower string")


def test_columns_follow_the_table_and_skip_generated(spark):
    df = cut_table(users(spark), USERS, SliceSpec("users", columns=("name", "id")))
    assert df.columns == ["id", "name"]
    assert cut_table(users(spark), USERS, SliceSpec("users")).columns == ["id", "email", "prefs", "name"]


@pytest.mark.parametrize("slc,part", [
    (dict(columns=("nope",)), "Available: id, email"),
    (dict(exclude_columns=("nope",)), "exclude_columns"),
    (dict(columns=("id", "email_lower")), "generated"),
    (dict(exclude_columns=("id", "email", "prefs", "name")), "every column"),
    (dict(columns=("email",)), "upsert"),
])
def test_bad_columns(slc, part):
    with pytest.raises(SpecError, match=part):
        selected_columns(USERS, SliceSpec("users", **slc))


def test_unknown_order_column(spark):
    with pytest.raises(SpecError, match="order_by"):
        cut_table(users(spark), USERS, SliceSpec("users", order_by=("nope",), limit=1))


def test_total_order_and_limit(spark):
    slc = SliceSpec("users", order_by=("name",), limit=3)
    assert order_columns(USERS, selected_columns(USERS, slc), slc) == ["name", "id", "email"]
    got = [r["name"] for r in cut_table(users(spark), USERS, slc).collect()]
    assert got == ["Ann", "Zoe", "ann"]  # byte order; the null comes last and is cut


def test_predicate_keeps_its_own_or(spark):
    slc = SliceSpec("users", where="id = 1 OR id = 4")
    assert cut_table(users(spark), USERS, slc).filter("id > 1").count() == 1


def test_key_filter_drops_nulls(spark):
    keys = spark.createDataFrame([("a@x",), ("a@x",), (None,)], "e string")
    assert [r["id"] for r in key_filter(users(spark), keys, [("email", "e")]).collect()] == [1]


def test_align(spark):
    got = align_to_spec(users(spark).select("name", "id"), USERS)
    assert got.columns == USERS.column_names and got.filter("email IS NOT NULL").count() == 0
    with pytest.raises(SpecError):
        align_to_spec(users(spark).withColumn("x", F.lit(1)), USERS)


def test_merge_key_choice():
    assert merge_key(USERS) == ("id",)
    assert merge_key(USERS, SliceSpec("users", key=("email",))) == ("email",)
    with pytest.raises(SpecError, match="not backed"):
        merge_key(USERS, SliceSpec("users", key=("name",)))
    partial_first = TableSpec("t", (int_col("a"), int_col("b")), (),
                              (UniqueKey(("a",), "b > 1"), UniqueKey(("b",))))
    assert merge_key(partial_first) == ("b",)


def test_select_and_restrict():
    slices = [SliceSpec("public.users"), SliceSpec("orders")]
    assert [s.table for s in select_tables(slices, ["orders", "users"])] == ["public.users", "orders"]
    with pytest.raises(SpecError, match="not configured: zap"):
        select_tables(slices, ["zap"])
    a = TableSpec("a", (int_col("id"),), ("id",))
    b = TableSpec("b", (int_col("id"), int_col("a_id")), ("id",), (), (ForeignKey(("a_id",), "a", ("id",)),))
    c = TableSpec("c", (int_col("id"),), ("id",))
    assert list(restrict(SchemaSpec.of(a, b, c), ["b"]).tables) == ["a", "b"]


def test_column_order_and_struct():
    live = TableSpec("t", (int_col("new"), int_col("b"), int_col("a")))
    old = TableSpec("t", (int_col("a"), int_col("gone"), int_col("b")))
    assert align_column_order(old, live).column_names == ["a", "b", "new"]
    assert spec_from_schema("users", to_struct(USERS.columns)).column("email").max_len == 10


def test_row_index_over_many_partitions(spread):
    df = spread.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(8)
    got = row_index(df, [F.col("k").asc()])
    assert got.filter(F.col("row_index") != F.col("k") + 1).count() == 0
    assert got.count() == 5000


def test_rank_in_group_with_one_huge_group(spread):
    df = spread.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = rank_in_group(df.repartition(8), ["g"], [F.col("id").asc()])
    hot = got.filter("g = 'hot'")
    assert hot.count() == 4000
    # ids 1, 2, 4, 5, 7, ... rank 1, 2, 3, ...
    assert hot.filter(F.col("rank") != F.col("id") - F.floor(F.col("id") / 3)).count() == 0
    assert got.filter("g <> 'hot' AND rank <> 1").count() == 0


def test_duplicate_rows_and_violations(spread):
    spec = TableSpec("t", (int_col("k"), text_col("v", 3, nullable=False)), ())
    df = spread.createDataFrame([(2, "c"), (1, "a"), (1, "b"), (1, "dddd"), (3, None)], "k long, v string")
    dup = duplicate_rows(df.repartition(8), spec, ["k"]).collect()
    assert [(r["k"], r["first_row"], r["second_row"]) for r in dup] == [(1, 1, 2)]
    got = {(r["rule"], r["row_index"], r["value"]) for r in indexed_violations(df, spec).collect()}
    assert got == {("max_length", 3, "4"), ("not_null", 5, None)}
    texts = spread.createDataFrame([("1", "a"), ("x", "b")], "k string, v string")
    assert [r["value"] for r in row_violations(texts, spec, parse=True).collect()] == ["x"]


def test_digest_ignores_partitions_and_order_but_nothing_else(spark):
    df = spark.createDataFrame([(i, f"v{i}", i / 7) for i in range(500)], "k long, v string, f double")
    one = table_digest(df).first()
    assert table_digest(df.orderBy(F.desc("k")).repartition(7)).first() == one
    assert table_digest(df.withColumn("v", F.when(F.col("k") == 3, "x").otherwise(F.col("v")))).first() != one
    assert table_digest(df.unionByName(df.limit(1))).first() != one
    a = spark.createDataFrame([("a|1:b", None)], "x string, y string")
    b = spark.createDataFrame([("a", "b")], "x string, y string")
    assert table_digest(a).first() != table_digest(b).first()


def test_copies_of_one_row_are_spread_over_tasks(spread):
    df = spread.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k")).repartition(8)
    got = row_index(df, [F.col("k").asc()])
    assert got.agg(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()[:] == (1, 9000, 9000)
    assert got.filter("k = -1").agg(F.max("row_index")).first()[0] == 3000
    tasks = got.filter("k = -1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_a_large_limit_goes_by_row_number(spark, spread, monkeypatch):
    from tableslice.operators import slicing

    spec = TableSpec("t", (int_col("id"), text_col("v")), ("id",))
    rows = spark.range(500).selectExpr("(id * 37) % 500 AS id", "cast(id % 7 AS string) AS v").repartition(7)
    slc = SliceSpec("t", order_by=("v",), limit=123)
    small = [tuple(r) for r in cut_table(rows, spec, slc).collect()]
    monkeypatch.setattr(slicing, "TOP_K", 10)
    assert sorted(tuple(r) for r in cut_table(rows, spec, slc).collect()) == sorted(small)
    bare = TableSpec("t", spec.columns)
    copies = rows.unionAll(rows)
    assert cut_table(copies, bare, slc).count() == 123
