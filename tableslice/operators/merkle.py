"""Hash trees over a table's rows: one digest in row order, and trees that show where two tables differ.

A tree over key ranges is a trie over the hexadecimal digits of the key's
SHA-256: the node of a prefix holds the rows whose key begins with it, so both
tables part their rows alike whatever they hold, and no range is hot.  Two
tables are compared from the root down, and only ranges whose hashes differ are
gone into.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..session import cut
from ..spec import SliceSpec, TableSpec, merge_key
from .diff import row_diff
from .digest import hash_sums, row_text
from .rowindex import row_index
from .slicing import col, total_order

#: Hashes that one node of the ordered digest joins.
FANOUT = 1024
#: Digits of the key's hash that name a range: 16 ** 3 ranges.
DIGITS = 3


def _joined(order: str, sha: str) -> Column:
    """SHA-256 over hashes one after the other, in the order of another column."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(sha))))
    return F.sha2(F.array_join(F.transform(held, lambda x: x[sha]), ""), 256)


def ordered_digest(df: DataFrame, spec: TableSpec, exact: bool = True) -> DataFrame:
    """``rows, sha256`` of a table's rows in their total order.

    Row hashes are joined ``FANOUT`` at a time by the rows' numbers, those of the
    joined again, up to one root; an empty table has the hash of nothing.  No
    task joins more than one node's hashes.
    """
    hashed = df.withColumn("__sha", F.sha2(row_text(df, spec, exact), 256))
    if spec.primary_key:  # the order needs no more than the key
        hashed = hashed.select(*[col(c) for c in spec.primary_key], "__sha")
    numbered = row_index(hashed, total_order(spec), "__row", unique=bool(spec.primary_key))
    nodes = numbered.select((F.col("__row") - 1).alias("at"), F.col("__sha").alias("sha"), F.lit(1).cast("long").alias("rows"))
    while True:
        nodes = cut(
            nodes.groupBy(F.floor(F.col("at") / FANOUT).alias("node")).agg(_joined("at", "sha").alias("sha"), F.sum("rows").alias("rows"))
            .select(F.col("node").alias("at"), "sha", "rows")
        )
        if nodes.limit(2).count() < 2:
            break
    return nodes.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("sha256"))


def key_range(df: DataFrame, spec: TableSpec, key: Sequence[str], digits: int = DIGITS) -> Column:
    """The range of each row: the first digits of the SHA-256 of its key's canonical text."""
    return F.substring(F.sha2(row_text(df.select(*[col(k) for k in key]), spec), 256), 1, digits)


def digest_tree(df: DataFrame, spec: TableSpec, key: Sequence[str] | None = None, digits: int = DIGITS,
                exact: bool = True) -> DataFrame:
    """``level, range, rows, sha256`` of every node: level 0 is the root, level ``digits`` has the ranges.

    A range's hash covers the multiset of its rows' hashes, which are added up
    before the shuffle; a node's covers its children's names and hashes in
    order.  Ranges without rows have no node.
    """
    key = tuple(key or merge_key(spec, SliceSpec(spec.name)))
    if not key:
        raise SpecError(f"table {spec.name} has no key to part it by")
    ranged = df.withColumn("__range", key_range(df, spec, key, digits))
    hashed = ranged.select(F.col("__range").alias("range"), F.sha2(row_text(df, spec, exact), 256).alias("sha"))
    sums = hash_sums(F.col("sha"))
    leaves = hashed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *sums)
    names = [f"s{i}" for i in range(len(sums))]
    level = cut(leaves.select(
        "range", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *names), 256).alias("sha256")))
    out = [level.select(F.lit(digits).alias("level"), "*")]
    for k in range(digits - 1, -1, -1):
        child = level.select(F.substring("range", 1, k).alias("parent"), "range", "rows",
                             F.concat("range", F.lit(":"), "sha256", F.lit(";")).alias("said"))
        level = child.groupBy("parent").agg(F.sum("rows").alias("rows"), _joined("range", "said").alias("sha256")).select(
            F.col("parent").alias("range"), "rows", "sha256")
        out.append(level.select(F.lit(k).alias("level"), "*"))
    return cut(reduce(DataFrame.unionByName, out).coalesce(1))


def differing_ranges(mine: DataFrame, theirs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``range, rows, other_rows`` of the ranges whose rows differ, found from the roots of two trees down."""
    def level(tree, k, name):
        return tree.filter(F.col("level") == k).select("range", F.col("rows").alias(f"{name}rows"), F.col("sha256").alias(f"{name}sha"))

    open_ = None
    for k in range(digits + 1):
        a, b = level(mine, k, ""), level(theirs, k, "other_")
        if k and open_ is not None:  # only children of nodes that differ
            parent = F.broadcast(open_.select(F.col("range").alias("parent")))
            a, b = (x.join(parent, F.substring("range", 1, k - 1) == F.col("parent"), "left_semi") for x in (a, b))
        open_ = a.join(b, "range", "full_outer").filter(~F.col("sha").eqNullSafe(F.col("other_sha")))
        if k == 0 and open_.isEmpty():
            break
    zero = F.lit(0).cast("long")
    return open_.select("range", F.coalesce("rows", zero).alias("rows"), F.coalesce("other_rows", zero).alias("other_rows"))


def write_ranges(df: DataFrame, path: str, spec: TableSpec, key: Sequence[str] | None = None,
                 digits: int = DIGITS) -> None:
    """A table in one folder per key range, with its tree beside, for ``range_diff``."""
    key = tuple(key or merge_key(spec, SliceSpec(spec.name)))
    tree = digest_tree(df, spec, key, digits)
    df.withColumn("key_range", key_range(df, spec, key, digits)).repartition("key_range").write.partitionBy(
        "key_range").mode("overwrite").parquet(f"{path}/rows")
    tree.write.mode("overwrite").parquet(f"{path}/tree")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/empty")  # its columns and types


def range_diff(spark: SparkSession, seed_path: str, live_path: str, spec: TableSpec, slc: SliceSpec | None = None,
               digits: int = DIGITS) -> DataFrame:
    """``row_diff`` of two tables written by ``write_ranges``, reading only ranges that differ.

    Rows of equal ranges are unchanged and not among the result.  The names of
    differing ranges (at most 16 ** ``digits``) go through the driver; folders
    of other ranges are not even listed.
    """
    trees = [spark.read.parquet(f"{p}/tree") for p in (seed_path, live_path)]
    ranges = differing_ranges(*trees, digits).collect()

    def rows(path: str, count: str) -> DataFrame:
        none = spark.read.parquet(f"{path}/empty")
        folders = [f"{path}/rows/key_range={r['range']}" for r in ranges if r[count]]
        return spark.read.schema(none.schema).parquet(*folders) if folders else none

    return row_diff(rows(seed_path, "rows"), rows(live_path, "other_rows"), spec, slc)
