"""Seed files: JSON lines, CSV, SQL inserts, one file per row, objects."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SHOWN, SpecError, more
from ..functions.canonical import canonicalize, parse_canonical, swap_bool_number, to_text
from ..functions.jsontext import embed, is_json, quote
from ..functions.names import BARE_NUMBER, csv_field, quote_identifier, slug, sql_literal
from ..operators.rowindex import rank_in_group, row_index, sort_rows
from ..operators.slicing import col, total_order
from ..session import pin_session
from ..spec import ColumnSpec, SliceSpec, TableSpec, merge_key
from .records import csv_records
from .store import list_files, write_named

DEFAULT_SQL_BATCH = 100


# --- one row as text ---------------------------------------------------------


def json_value(c: Column, spec: ColumnSpec, held: T.DataType | None = None,
               mode: str = "unroll", exact: bool = True) -> Column:
    """A column's value inside a JSON row; NULL is ``null``.

    Decimals stay bare with all their digits where a JSON number can say them;
    non-finite floats and exponent forms are quoted.
    """
    text = to_text(c, spec, held, exact)
    if spec.kind in ("bool", "int"):
        out = text
    elif spec.kind == "decimal":
        out = F.when(text.rlike(BARE_NUMBER), text).otherwise(quote(text))
    elif spec.kind == "float":
        out = F.when(text.isin("NaN", "Infinity", "-Infinity"), quote(text)).otherwise(text)
    elif spec.kind == "json":
        out = embed(text, mode)
    else:
        out = quote(text)
    return F.coalesce(out, F.lit("null"))


def json_row(df: DataFrame, spec: TableSpec, mode: str = "unroll", pretty: bool = False,
             exact: bool = True) -> Column:
    """A row as one JSON object, keys in column order."""
    gap, colon, end = ("\n  ", ": ", "\n") if pretty else ("", ":", "")
    parts: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        name = json.dumps(f.name, ensure_ascii=False)
        parts.append(F.lit(("," if i else "{") + gap + name + colon))
        parts.append(json_value(col(f.name), spec.require(f.name, "columns"), f.dataType, mode, exact))
    return F.concat(*parts, F.lit(end + "}"))


def csv_row(df: DataFrame, spec: TableSpec, exact: bool = True) -> Column:
    fields = [
        csv_field(to_text(col(f.name), spec.require(f.name, "columns"), f.dataType, exact))
        for f in df.schema.fields
    ]
    return F.concat_ws(",", *fields)


def _ordered(df: DataFrame, spec: TableSpec, slc: SliceSpec | None) -> DataFrame:
    return sort_rows(df, total_order(spec, slc or _of(df, spec)), _has_key(df, spec))


def _has_key(df: DataFrame, spec: TableSpec) -> bool:
    """Whether the rows carry a primary key, so that no two are equal."""
    return bool(spec.primary_key) and set(spec.primary_key) <= set(df.columns)


def _of(df: DataFrame, spec: TableSpec) -> SliceSpec:
    """The slice a DataFrame already is: its own columns."""
    return SliceSpec(spec.name, columns=tuple(df.columns), load="insert")


# --- JSON lines --------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, spec: TableSpec, slc: SliceSpec | None = None,
                mode: str = "unroll", compression: str | None = None) -> None:
    """One JSON object per line, in total order across the part files.

    ``compression="gzip"`` compresses the parts.  Digests are taken over rows,
    not files, so neither parts nor compression change them.
    """
    lines = _ordered(df, spec, slc).select(json_row(df, spec, mode).alias("value"))
    writer = lines.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def _string_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(c.name, T.StringType()) for c in spec.columns])


def _unknown_keys(lines: DataFrame, spec: TableSpec) -> list[str]:
    """Keys in the files that the table lacks: a few distinct names at most,
    found in one pass that keeps only unknown ones."""
    known = F.array(*[F.lit(n) for n in spec.column_names])
    found = lines.select(F.explode(F.array_except(F.json_object_keys("value"), known)).alias("k")).distinct()
    shown = found.orderBy("k").limit(SHOWN).collect()
    return [r["k"] for r in shown] + ([more(found, shown).strip()] if more(found, shown) else [])


def read_jsonl(spark: SparkSession, path: str, spec: TableSpec, check: bool = True,
               multiline: bool = False) -> DataFrame:
    """Typed rows; an absent column is NULL, an unknown one an error.

    Values are read as their source text, so no digit is lost before the typed
    parse.  A value that does not parse fails the job; ``row_violations`` over
    ``read_jsonl_text`` with ``parse=True`` lists all of them.  ``check=False``
    saves the pass that looks for unknown columns.
    """
    texts = read_jsonl_text(spark, path, spec, check, multiline)
    return parse_canonical(texts, spec, strict=True)


def read_jsonl_text(spark: SparkSession, path: str, spec: TableSpec, check: bool = True,
                    multiline: bool = False) -> DataFrame:
    """The same rows still as text, which is what the row checks take."""
    pin_session(spark)
    if check:
        lines = spark.read.option("wholetext", multiline).text(path).filter("trim(value) <> ''")
        unknown = _unknown_keys(lines, spec)
        if unknown:
            raise SpecError(
                f"table {spec.name}: {path} holds column(s) {', '.join(unknown)} "
                "that the table does not have"
            )
    rows = (
        spark.read.schema(_string_schema(spec)).option("mode", "FAILFAST")
        .option("multiLine", multiline).json(path)
    )
    return rows.select(*[_decoded(col(c.name), c).alias(c.name) for c in spec.columns])


def _decoded(c: Column, spec: ColumnSpec) -> Column:
    if spec.kind == "json":
        # A string that is itself JSON is the document; any other is a string.
        return F.when(c.isNull() | is_json(c), c).otherwise(quote(c))
    return swap_bool_number(c, spec)


# --- CSV ---------------------------------------------------------------------

# Read settings under which an unquoted empty field is NULL and "" is ''.
_CSV = {"escape": '"', "nullValue": "\u0001", "emptyValue": "", "mode": "FAILFAST",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, spec: TableSpec, slc: SliceSpec | None = None) -> None:
    """CSV with a header in each part; NULL is an empty field, '' is ``""``."""
    canonicalize(_ordered(df, spec, slc), spec).write.mode("overwrite").options(
        header="true", escape='"', nullValue="", emptyValue='""',
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def read_csv_text(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    pin_session(spark)
    header = spark.read.options(header="true", **_CSV).csv(path).columns
    for name in header:
        spec.require(name, "csv header")
    fields = ", ".join(f"c{i} string" for i in range(len(header)))
    records = csv_records(spark, path).filter("text <> ''").select(
        "file", "top", F.from_csv("text", fields, {**_CSV, "multiLine": "true"}).alias("row"))
    # Every file begins with the same header.
    mark = F.regexp_replace("row.c0", "^\ufeff", "")
    same = F.array(mark, *[F.col(f"row.c{i}") for i in range(1, len(header))]) == F.array(*map(F.lit, header))
    other = F.raise_error(F.concat(
        F.lit(f"table {spec.name}: the header of "), "file", F.lit(f" is not {', '.join(header)}"))).cast("boolean")
    rows = records.filter(F.when(~F.col("top"), True).otherwise(~F.when(same, True).otherwise(other)))
    at = {n: F.col(f"row.c{i}") for i, n in enumerate(header)}
    return rows.select(*[at.get(c.name, F.lit(None).cast("string")).alias(c.name) for c in spec.columns])


def read_csv(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Typed rows.  A column the header lacks is NULL; an unknown column, a
    row of another width or a value that does not parse is an error.  Quoted
    fields may hold line ends, and a large file is still read by many tasks."""
    return parse_canonical(read_csv_text(spark, path, spec), spec, strict=True)


# --- SQL inserts -------------------------------------------------------------


def conflict_clause(spec: TableSpec, columns: Sequence[str], slc: SliceSpec) -> str:
    if slc.load in ("insert", "truncate_first"):
        return ""
    if slc.load == "skip_existing":
        return " ON CONFLICT DO NOTHING"
    key = merge_key(spec, slc)
    if not key:
        raise SpecError(f"table {spec.name} has no key to conflict on; use load='insert'")
    target = f"({', '.join(quote_identifier(k) for k in key)})"
    unique = spec.conflict_target(key)
    if unique and unique.partial:
        target += f" WHERE {unique.predicate}"
    sets = ", ".join(
        f"{quote_identifier(c)} = EXCLUDED.{quote_identifier(c)}" for c in columns if c not in key
    )
    return f" ON CONFLICT {target} DO " + (f"UPDATE SET {sets}" if sets else "NOTHING")


def sql_tuple(df: DataFrame, spec: TableSpec) -> Column:
    parts = [
        sql_literal(to_text(col(f.name), spec.require(f.name, "columns"), f.dataType),
                    spec.require(f.name, "columns"))
        for f in df.schema.fields
    ]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def sql_insert_lines(df: DataFrame, spec: TableSpec, slc: SliceSpec | None = None,
                     batch: int = DEFAULT_SQL_BATCH) -> DataFrame:
    """``row_index, value``: INSERT statements of ``batch`` rows each.

    A row knows from its number whether it opens or closes a statement, so the
    rows of a statement never have to be gathered.
    """
    slc = slc or _of(df, spec)
    header = "INSERT INTO {} ({}) VALUES".format(
        quote_identifier(spec.name), ", ".join(quote_identifier(c) for c in df.columns)
    )
    end = conflict_clause(spec, df.columns, slc) + ";"
    numbered = row_index(df, total_order(spec, slc), unique=_has_key(df, spec))
    last = numbered.agg(F.max("row_index").alias("last")).select("last", F.lit(1).alias("one"))
    n = F.col("row_index")
    opens = (n - 1) % batch == 0
    closes = (n % batch == 0) | (n == F.col("last"))
    return (
        numbered.select("*", F.lit(1).alias("one")).join(F.broadcast(last), "one")
        .select("row_index", F.concat(
            F.when(opens, header + "\n").otherwise(""), F.lit("  "), sql_tuple(df, spec),
            F.when(closes, end).otherwise(","),
        ).alias("value"))
    )


def write_sql_inserts(df: DataFrame, path: str, spec: TableSpec, slc: SliceSpec | None = None,
                      batch: int = DEFAULT_SQL_BATCH) -> None:
    lines = sql_insert_lines(df, spec, slc, batch)
    lines.orderBy("row_index").select("value").write.mode("overwrite").text(path)


# --- one file per row --------------------------------------------------------


def row_slugs(df: DataFrame, spec: TableSpec, name: str = "slug") -> DataFrame:
    """A file name per row from its key, unique even where slugs collide.

    Colliding rows get ``-2``, ``-3``, ... in total order.  A suffixed name may
    itself be another row's slug, so this repeats until all names differ.
    """
    key = [k for k in spec.primary_key if k in df.columns]
    order = total_order(spec, _of(df, spec))
    if len(key) != len(spec.primary_key) or not key:
        numbered = row_index(df, order, "__n")
        return numbered.select(
            *[col(c) for c in df.columns],
            F.format_string("%06d", F.col("__n") - 1).alias(name),
        )
    parts = [slug(to_text(col(k), spec.require(k, "key"), df.schema[k].dataType)) for k in key]
    rows = df.withColumn(name, F.concat_ws("-", *parts))
    while True:
        clash = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if clash.isEmpty():
            return rows
        ranked = rank_in_group(rows, [name], order, "__rank")
        rows = ranked.select(
            *[col(c) for c in df.columns],
            F.when(F.col("__rank") > 1, F.concat(col(name), F.lit("-"), F.col("__rank")))
            .otherwise(col(name)).alias(name),
        )


def write_per_row(df: DataFrame, path: str, spec: TableSpec, mode: str = "unroll",
                  pretty: bool = True) -> None:
    """One JSON file per row, ``<path>/<slug>.json``.  For small tables."""
    named = row_slugs(df, spec)
    write_named(named.select(F.col("slug").alias("name"), json_row(df, spec, mode, pretty).alias("value")), path)


def read_per_row(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Rows of such a directory, whatever its files are called."""
    pin_session(spark)
    rows = (
        spark.read.schema(_string_schema(spec)).option("mode", "FAILFAST")
        .option("multiLine", True).option("recursiveFileLookup", True).json(path)
    )
    return parse_canonical(
        rows.select(*[_decoded(col(c.name), c).alias(c.name) for c in spec.columns]), spec, strict=True
    )


# --- documents and objects ---------------------------------------------------


def read_documents(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """JSON documents, one per line, as VARIANT."""
    lines = pin_session(spark).read.text(path).filter("trim(value) <> ''")
    return lines.select(F.parse_json("value").alias(column))


def read_objects(spark: SparkSession, root: str, prefix: str = "",
                 max_bytes: int | None = None, empty: bool = True) -> DataFrame:
    """``path, length, content`` of every object below ``root``.

    Path and length are known from the listing; a job that does not use
    ``content`` reads no bytes.  An object above ``max_bytes`` is an error.
    Spark's file readers pass over empty files, so tasks list those beside;
    ``empty=False`` saves that listing where there are none.
    """
    base = f"{root.rstrip('/')}/{prefix.strip('/')}" if prefix else root
    files = pin_session(spark).read.format("binaryFile").option(
        "recursiveFileLookup", "true").load(base).select("path", "length", "content")
    if max_bytes is not None:
        large = files.filter(F.col("length") > max_bytes).select("path", "length")
        shown = large.orderBy("path").limit(SHOWN).collect()
        if shown:
            raise SpecError(f"object(s) above {max_bytes} bytes: " + ", ".join(
                f"{r['path']} ({r['length']})" for r in shown) + more(large, shown))
    if empty:
        none = list_files(spark, base).filter("length = 0")
        files = files.unionByName(none.select(
            "path", F.lit(0).cast("bigint").alias("length"), F.unhex(F.lit("")).alias("content")))
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    key = F.regexp_replace("path", "^.*?" + _literal(plain) + "/", "")
    return files.select(key.alias("path"), "length", "content")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"

