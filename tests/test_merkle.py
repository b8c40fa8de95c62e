"""Hash trees: order, comparison from the root, and that equal ranges are not read."""

import hashlib

from pyspark.sql import functions as F

from tableslice.operators import merkle
from tableslice.operators.digest import row_digests
from tableslice.operators.diff import row_diff
from tableslice.spec import SliceSpec, TableSpec, int_col, text_col

SPEC = TableSpec("t", (int_col("id"), text_col("v", None)), ("id",))
LOOSE = TableSpec("t", (int_col("id"), text_col("v", None)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(hashes, fanout):
    while True:
        hashes = [sha("".join(hashes[i:i + fanout])) for i in range(0, len(hashes), fanout)]
        if len(hashes) < 2:
            return hashes[0] if hashes else sha("")


def test_ordered_digest_like_a_loop(spark, spread, monkeypatch):
    monkeypatch.setattr(merkle, "FANOUT", 4)
    for n in (0, 1, 5, 70):
        df = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("v")).repartition(3)
        hashes = [r["row_sha256"] for r in row_digests(df, SPEC, keep=["id"]).orderBy("id").collect()]
        for spec in (SPEC, LOOSE):
            got = merkle.ordered_digest(df, spec).first()
            assert got["rows"] == n and (spec is LOOSE or got["sha256"] == root(hashes, 4))
        assert merkle.ordered_digest(df, LOOSE).first() == merkle.ordered_digest(df.repartition(5), LOOSE).first()


def test_trees_lead_to_the_changed_rows(spark):
    df = spark.range(3000).select("id", F.lit("x").alias("v"))
    other = df.filter("id <> 5").withColumn("v", F.when(F.col("id") == 77, "y").otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(9000, "z")], "id long, v string"))
    mine, theirs = (merkle.digest_tree(x, SPEC, digits=2) for x in (df, other.repartition(4)))
    changed = {sha(f"{len(str(i))}:{i}")[:2] for i in (5, 77, 9000)}
    assert {r["range"] for r in merkle.differing_ranges(mine, theirs, 2).collect()} == changed
    assert merkle.differing_ranges(mine, merkle.digest_tree(df.repartition(7), SPEC, digits=2), 2).count() == 0
    assert mine.filter("level = 0").first()["rows"] == 3000 and mine.filter("level = 2").count() == 256
    empty = merkle.digest_tree(df.limit(0), SPEC, digits=2)
    assert empty.count() == 0
    assert merkle.differing_ranges(mine, empty, 2).agg(F.sum("rows"), F.sum("other_rows")).first() == (3000, 0)


def test_equal_ranges_are_not_read(spark, tmp_path):
    df = spark.range(500).select("id", F.lit("x").alias("v"))
    other = df.withColumn("v", F.when(F.col("id").isin(3, 4), "y").otherwise(F.col("v")))
    for name, x in (("a", df), ("b", other), ("c", df.repartition(5))):
        merkle.write_ranges(x, f"{tmp_path}/{name}", SPEC, digits=1)
    slc = SliceSpec("t", load="truncate_first")
    found = merkle.range_diff(spark, f"{tmp_path}/b", f"{tmp_path}/a", SPEC, slc, digits=1)
    files = {f.split("key_range=")[1][0] for f in found.inputFiles()}
    assert files == {sha("1:3")[0], sha("1:4")[0]}
    full = row_diff(other, df, SPEC, slc).filter("change <> 'unchanged'")
    assert sorted(map(str, found.filter("change <> 'unchanged'").collect())) == sorted(map(str, full.collect()))
    same = merkle.range_diff(spark, f"{tmp_path}/c", f"{tmp_path}/a", SPEC, slc, digits=1)
    assert not any("key_range" in f for f in same.inputFiles()) and same.count() == 0
