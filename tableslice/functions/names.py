"""Text for file names, SQL literals, CSV fields and name suggestions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import ColumnSpec

# Longest plain slug, and how much of a longer one is kept.
SLUG_MAX = 48
SLUG_HEAD = 40
SLUG_HASH = 8

BARE_NUMBER = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


def slug(text: Column) -> Column:
    """File-name-safe form of canonical text; long ones end in a hash."""
    dashed = F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), r"[^a-z0-9_-]", "-")
    short = F.trim(F.regexp_replace(dashed, "-+", "-"), F.lit("-"))
    return (
        F.when(text.isNull(), "null")
        .when(short == "", "empty")
        .when(
            F.length(short) > SLUG_MAX,
            F.concat(
                F.substring(short, 1, SLUG_HEAD),
                F.lit("-"),
                F.substring(F.sha2(text, 256), 1, SLUG_HASH),
            ),
        )
        .otherwise(short)
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sql_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_type(spec: ColumnSpec) -> str:
    """Type name used in the cast of a literal (one ANSI/Postgres flavour)."""
    names = {
        "bool": "boolean", "bytes": "bytea", "uuid": "uuid", "date": "date",
        "interval": "interval", "text": "text",
    }
    k = spec.kind
    if k == "int":
        return {8: "smallint", 16: "smallint", 32: "integer"}.get(spec.bits or 64, "bigint")
    if k == "float":
        return "real" if spec.bits == 32 else "double precision"
    if k == "decimal":
        return "numeric" if spec.precision is None else f"numeric({spec.precision},{spec.scale or 0})"
    if k == "text" and spec.max_len is not None:
        return f"character varying({spec.max_len})"
    if k == "json":
        return "jsonb" if spec.binary else "json"
    if k in ("time", "timestamp"):
        return f"{k} {'with' if spec.tz else 'without'} time zone"
    if k == "enum":
        return spec.type_name or "text"
    if k == "array":
        return f"{sql_type(spec.of)}[]" if spec.of else "text[]"
    return names.get(k) or spec.type_name or "text"


def sql_literal(text: Column, spec: ColumnSpec) -> Column:
    """Self-contained SQL literal of a canonical text column."""
    cast = F.concat(sql_quote(text), F.lit(f"::{sql_type(spec)}"))
    if spec.kind == "bool":
        out = F.upper(text)
    elif spec.kind == "int":
        out = text
    elif spec.kind == "float":
        out = F.when(text.isin("NaN", "Infinity", "-Infinity"), cast).otherwise(text)
    elif spec.kind == "decimal":
        out = F.when(text.rlike(BARE_NUMBER), text).otherwise(cast)
    else:
        out = cast
    return F.coalesce(out, F.lit("NULL"))


def csv_field(text: Column) -> Column:
    """One CSV field: NULL is nothing, '' is a quoted empty field."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = (text == "") | text.rlike(r'[,"\r\n]|^ | $')
    return F.when(text.isNull(), "").when(needs, quoted).otherwise(text)


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def suggestion(wanted: Column, known: Sequence[str]) -> Column:
    """The known table or column name closest to ``wanted``, if close enough.

    Close enough means an edit distance of at most a third of the longer name.
    The known names are a catalog's, so they travel in the expression: each
    wanted name is compared where it is, without a join.
    """
    scored = F.array(*[
        F.struct(F.levenshtein(wanted, F.lit(k)).alias("distance"), F.lit(k).alias("name"),
                 F.greatest(F.length(wanted), F.lit(len(k))).alias("size"))
        for k in known
    ])
    near = F.filter(scored, lambda s: s["distance"] * 3 <= s["size"])
    return F.array_min(near)["name"]


def closest(name: str, known: Iterable[str]) -> str | None:
    """Driver-side suggestion over a handful of table names."""
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    scored = [(distance(name, k), k) for k in known]
    near = [(d, k) for d, k in scored if d * 3 <= max(len(name), len(k))]
    return min(near)[1] if near else None
