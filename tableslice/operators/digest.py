"""Content digests of rows, tables, sets of tables, and schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import to_text
from ..functions.jsontext import canonical_json
from ..spec import TableSpec, spec_from_schema
from .slicing import col

# A 256-bit hash is summed as eight 32-bit pieces; 28 digits per term leave
# room for any number of rows in a 38-digit sum.
_PIECE_HEX = 8
_PIECES = 8
_TERM = T.DecimalType(28, 0)
_NULL = "\\N"


def row_text(df: DataFrame, spec: TableSpec | None = None, exact: bool = True) -> Column:
    """One unambiguous text per row: its canonical values, joined.

    Values are prefixed by their length, NULL is ``\\N``, so no value can imitate
    a separator.  JSON values count by content, not by spelling.
    """
    spec = spec or spec_from_schema("table", df.schema)
    parts = []
    for f in df.schema.fields:
        c = spec.require(f.name, "columns")
        text = to_text(col(f.name), c, f.dataType, exact)
        if c.kind == "json":
            text = canonical_json(text, exact)
        parts.append(F.coalesce(
            F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(_NULL)
        ))
    return F.concat_ws("|", *parts)


def row_digests(df: DataFrame, spec: TableSpec | None = None, keep: Sequence[str] = (),
                exact: bool = True) -> DataFrame:
    """``sha256`` of each row's canonical text, beside the ``keep`` columns."""
    return df.select(
        *[col(k) for k in keep], F.sha2(row_text(df, spec, exact), 256).alias("row_sha256")
    )


def hash_sums(hash_hex: Column) -> list[Column]:
    """Sums of the pieces of hashes, ``s0`` to ``s7``: the same in any order and grouping."""
    return [
        F.coalesce(
            F.sum(F.conv(F.substring(hash_hex, 1 + i * _PIECE_HEX, _PIECE_HEX), 16, 10).cast(_TERM)),
            F.lit(0),
        ).cast("string").alias(f"s{i}")
        for i in range(_PIECES)
    ]


def combine_hashes(df: DataFrame, hash_hex: Column) -> DataFrame:
    """``rows, sha256`` over a multiset of hashes, whatever their order.

    The order of a table's rows follows from the rows themselves, so a digest
    of the multiset says as much as one of the sorted file, needs no sort, and
    merges partial sums: it is the same under any partitioning.
    """
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *hash_sums(hash_hex))
    body = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{i}") for i in range(_PIECES)])
    return sums.select("rows", F.sha2(body, 256).alias("sha256"))


def table_digest(df: DataFrame, spec: TableSpec | None = None, exact: bool = True) -> DataFrame:
    """``rows, sha256`` of a table's contents."""
    return combine_hashes(row_digests(df, spec, exact=exact), F.col("row_sha256"))


def table_digests(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None = None,
                  exact: bool = True) -> DataFrame:
    """``table, rows, sha256``, one row per table."""
    specs = specs or {}
    return reduce(DataFrame.unionByName, [
        table_digest(df, specs.get(name), exact).select(F.lit(name).alias("table"), "rows", "sha256")
        for name, df in tables.items()
    ])


def digest_of_digests(digests: DataFrame, path: str = "table", sha: str = "sha256") -> DataFrame:
    """One hash over named hashes: path, NUL, hash, NUL in path order.

    For listings with one entry per *table*; the entries are sorted in one
    place.  For listings that grow with the data use ``manifest_digest``.
    """
    entry = F.struct(
        col(path).alias("p"),
        F.concat(col(path), F.lit("\0"), col(sha), F.lit("\0")).alias("t"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "")
    return digests.agg(F.sha2(joined, 256).alias("sha256"))


def schema_fingerprint(columns: DataFrame, keys: DataFrame | None = None,
                       fks: DataFrame | None = None, enums: DataFrame | None = None) -> DataFrame:
    """Short hash of a catalog that ignores the order of everything in it.

    The input is a catalog (one row per column, key and reference), so sorting
    its lines in one place is bounded by the width of the schema.
    """
    def yes(c):
        return F.col(c).cast("string")

    lines = [columns.select(F.concat_ws(
        " ", F.lit("col"), "table", "column", "type",
        yes("nullable"), yes("has_default"), yes("generated")).alias("line"))]
    if keys is not None:
        lines.append(keys.select(F.concat_ws(
            " ", "key_kind", "table", F.array_join("columns", ","),
            F.coalesce(F.concat(F.lit("where "), F.col("predicate")), F.lit(""))).alias("line")))
    if fks is not None:
        lines.append(fks.select(F.concat_ws(
            " ", F.lit("fk"), "table", F.array_join("columns", ","), F.lit("->"), "references",
            F.array_join("ref_columns", ","), yes("deferrable")).alias("line")))
    if enums is not None:
        lines.append(enums.select(F.concat_ws(
            " ", F.lit("enum"), "name", F.array_join("labels", ",")).alias("line")))
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return reduce(DataFrame.unionByName, lines).agg(
        F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint")
    )
