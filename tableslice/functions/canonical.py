"""One text form per value, and the way back, as column expressions.

``to_text`` maps a typed column to canonical text and ``parse_text`` maps text
to the typed column (NULL where the text does not parse).  They are inverses:
``parse_text(to_text(c)) == c`` for every kind.  Everything here is built from
Spark SQL functions and stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import ColumnSpec, TableSpec, spec_from_schema
from .jsontext import canonical_json, is_json

# Accepted spellings of booleans and of non-finite floats.
TRUE_WORDS = ("t", "true", "TRUE", "True", "1", "y", "yes", "on")
FALSE_WORDS = ("f", "false", "FALSE", "False", "0", "n", "no", "off")
NON_FINITE = r"^[+-]?(?i:nan|inf|infinity)$"

BLANKS = " \t\n\u000b\f\r\u0085\u00a0\u2003\u3000"
_PAD = f"[{BLANKS}]*"
INTEGER = rf"^{_PAD}[+-]?[0-9]+{_PAD}$"
NUMBER = rf"^{_PAD}[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?{_PAD}$"
HEX = r"^(?:\\x|0x)?(?:[0-9a-fA-F]{2})*$"
UUID = (
    r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})"
    r"-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"
)
CLOCK = r"([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})(?:\.([0-9]{1,9}))?"
OFFSET = r"(Z|z|[+-][0-9]{1,2}(?::[0-9]{1,2}){0,2})?"
TIME = rf"^(?:{CLOCK}|([0-9]{{1,2}}:[0-9]{{1,2}})){OFFSET}$"
DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
STAMP = rf"^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:[ T]{CLOCK})? ?{OFFSET}$"
# Text a cast reads as it is: what this library and most engines write.
PLAIN_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _cast(c: Column, to) -> Column:
    """A cast trims plain blanks by itself; only where it fails is the text
    stripped of the others and tried again."""
    return F.coalesce(c.try_cast(to), strip(c).try_cast(to))


# --- typed value -> canonical text -----------------------------------------


def float_text(c: Column, exact: bool = True) -> Column:
    """The shortest digits that read back as the same double.

    The JVM's text always reads back exactly, but before Java 19 is sometimes a
    digit too long.  With at most 15 digits it cannot be (such decimals name
    distinct doubles); longer ones, and subnormals, go through a small Arrow
    function.  ``exact=False`` leaves that step out and the plan in the JVM.
    Placement: plain digits from 1e-5 up to 1e16, else an ``e``.
    """
    raw = c.cast("string")
    value = raw.cast("double")
    size = F.abs(value)
    # An exponent in the JVM's text, but not in ours: 16 digits before the point
    # and 22 after it hold every such double's text.
    spread = raw.cast(T.DecimalType(38, 22)).cast("string")
    text = (
        F.when(~raw.contains("E"), F.when(
            raw.endswith(".0"), F.left(raw, F.length(raw) - 2)).otherwise(raw))
        .when((size >= 1e-5) & (size < 1e16), F.regexp_replace(spread, r"\.?0+$", ""))
        .otherwise(F.regexp_replace(raw, r"(?:\.0)?E", "e"))
    )
    if not exact:
        return text
    long = (F.length(raw) > 16) | ((size > 0) & (size < 2.3e-308))
    # Every other row reaches Python as NULL.
    return F.coalesce(_shortest(F.when(long & (size < float("inf")), value)), text)


@F.arrow_udf(T.StringType())
def _shortest(values: pa.Array) -> pa.Array:
    def place(v):
        mantissa, _, power = f"{v!r}".partition("e")
        if not power:
            return mantissa.removesuffix(".0")
        if int(power) == -5:  # the one exponent our plain form still covers
            sign, digits = mantissa[: mantissa[0] == "-"], mantissa.lstrip("-").replace(".", "")
            return f"{sign}0.0000{digits}"
        return f"{mantissa}e{int(power)}"

    if values.null_count == len(values):
        return pa.nulls(len(values), pa.string())
    return pa.array([None if v is None else place(v) for v in values.to_pylist()], pa.string())


def stamp_text(c: Column, tz: bool) -> Column:
    """ISO text; a fraction has six digits or is absent; instants end in Z."""
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("Z" if tz else ""),
    )


def bytes_text(c: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def to_text(c: Column, spec: ColumnSpec, held: T.DataType | None = None,
            exact: bool = True) -> Column:
    """Canonical text of a typed column; NULL stays NULL.

    ``held`` is the Spark type the column really has, when it differs from the
    one the spec implies (a float table column held as decimal, say).
    ``exact=False`` keeps the plan free of Python, see ``float_text``.
    """
    held = held or spec.spark_type()
    if isinstance(held, (T.FloatType, T.DoubleType)):
        return float_text(c, exact)
    if isinstance(held, T.TimestampType):
        return stamp_text(c, True)
    if isinstance(held, T.TimestampNTZType):
        return stamp_text(c, False)
    if isinstance(held, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(held, T.BinaryType):
        return bytes_text(c)
    if isinstance(held, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def comparison_text(c: Column, spec: ColumnSpec, held: T.DataType | None = None,
                    exact: bool = True) -> Column:
    """Text two values are compared by: JSON by content, all else canonically.

    NULL is left NULL: compare with ``eqNullSafe``, so no marker can collide
    with a real value.
    """
    text = to_text(c, spec, held, exact)
    return canonical_json(text, exact) if spec.kind == "json" else text


# --- text -> typed value -----------------------------------------------------


def parse_bool(c: Column) -> Column:
    t = strip(c)
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def parse_int(c: Column, spec: ColumnSpec) -> Column:
    """Through bigint and a range check: a failing cast costs far more."""
    whole = F.when(c.rlike(INTEGER), _cast(c, "bigint"))
    bits = spec.bits or 64
    if bits == 64:
        return whole
    fits = whole.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    return F.when(fits, whole).cast(spec.spark_type())


def parse_float(c: Column, bits: int | None = 64) -> Column:
    t = strip(c)
    low = F.lower(F.ltrim(t, F.lit("+")))
    value = (
        F.when(c.rlike(NUMBER), _cast(c, "double"))
        .when(t.rlike(NON_FINITE), F.when(low.contains("nan"), F.lit(float("nan")))
              .when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )
    return value.cast("float") if bits == 32 else value


def parse_decimal(c: Column, spec: ColumnSpec) -> Column:
    held = spec.spark_type()
    if isinstance(held, T.DecimalType):
        return F.when(c.rlike(NUMBER), _cast(c, held))
    t = strip(c)
    return F.when(c.rlike(NUMBER) | t.isin("NaN", "nan"), t)


def parse_bytes(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(HEX), F.unhex(F.regexp_replace(t, r"^(?:\\x|0x)", "")))


def parse_uuid(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.rlike(UUID), F.regexp_replace(t, UUID, "$1-$2-$3-$4-$5"))


def parse_date(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(DATE), t.try_cast("date"))


def parse_time(c: Column) -> Column:
    """Time of day as canonical text; an offset has no anchor and is dropped."""
    t = strip(c)
    clock = F.coalesce(
        F.nullif(F.regexp_extract(t, TIME, 1), F.lit("")),
        F.concat(F.nullif(F.regexp_extract(t, TIME, 3), F.lit("")), F.lit(":00")),
    )
    micros = F.substring(F.rpad(F.regexp_extract(t, TIME, 2), 6, "0"), 1, 6)
    # Borrow timestamp parsing for the range checks and the zero padding.
    at = F.concat(F.lit("2000-01-01 "), clock).try_cast("timestamp_ntz")
    return F.when(
        t.rlike(TIME) & at.isNotNull(),
        F.concat(
            F.date_format(at, "HH:mm:ss"),
            F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        ),
    )


def parse_stamp(c: Column, tz: bool) -> Column:
    """Date and time, with or without an offset; an offset is folded to UTC."""
    t = strip(c)
    clock = F.coalesce(F.nullif(F.regexp_extract(t, STAMP, 2), F.lit("")), F.lit("00:00:00"))
    micros = F.substring(F.rpad(F.regexp_extract(t, STAMP, 3), 6, "0"), 1, 6)
    local = F.concat(F.regexp_extract(t, STAMP, 1), F.lit(" "), clock, F.lit("."), micros)
    offset = F.regexp_extract(t, STAMP, 4)
    sign = F.when(offset.startswith("-"), 1).otherwise(-1)
    part = [
        F.coalesce(
            F.regexp_extract(offset, rf"^[+-]{'[0-9]+:' * i}([0-9]+)", 1).try_cast("int"), F.lit(0)
        )
        for i in range(3)
    ]
    shift = F.make_dt_interval(
        F.lit(0), sign * part[0], sign * part[1], (sign * part[2]).cast(T.DecimalType(18, 6))
    )
    utc = F.when(c.rlike(PLAIN_STAMP), c.try_cast("timestamp_ntz")).when(
        t.rlike(STAMP), local.try_cast("timestamp_ntz") + shift
    )
    return utc.cast("timestamp") if tz else utc


def parse_text(c: Column, spec: ColumnSpec) -> Column:
    """The typed value of canonical (or any accepted) text, NULL if it fails."""
    k = spec.kind
    if k == "bool":
        return parse_bool(c)
    if k == "int":
        return parse_int(c, spec)
    if k == "float":
        return parse_float(c, spec.bits)
    if k == "decimal":
        return parse_decimal(c, spec)
    if k == "bytes":
        return parse_bytes(c)
    if k == "uuid":
        return parse_uuid(c)
    if k == "json":
        return F.when(is_json(c), c)
    if k == "date":
        return parse_date(c)
    if k == "time":
        return parse_time(c)
    if k == "timestamp":
        return parse_stamp(c, spec.tz)
    return c


def parse_failed(c: Column, spec: ColumnSpec) -> Column:
    """True where text is present but is no value of this kind."""
    return c.isNotNull() & parse_text(c, spec).isNull()


def swap_bool_number(c: Column, spec: ColumnSpec) -> Column:
    """JSON ``true``/``false`` read for a numeric column becomes 1 or 0.

    Engines without a boolean type keep one in an integer column.  The other
    direction (0 and 1 read for a boolean) is covered by ``parse_bool``.
    """
    if spec.kind in ("int", "decimal", "float"):
        return F.when(c == "true", "1").when(c == "false", "0").otherwise(c)
    return c


# --- whole tables ------------------------------------------------------------


def canonicalize(df: DataFrame, spec: TableSpec | None = None,
                 columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Every column as canonical text, in one projection."""
    spec = spec or spec_from_schema("table", df.schema)
    names = list(columns or df.columns)
    return df.select(*[
        to_text(F.col(f"`{n}`"), spec.require(n, "columns"), df.schema[n].dataType, exact).alias(n)
        for n in names
    ])


def parse_canonical(df: DataFrame, spec: TableSpec, strict: bool = False) -> DataFrame:
    """Typed columns from canonical text, the inverse of ``canonicalize``.

    Text that is no value of its column becomes NULL, or with ``strict`` fails
    the job that reads it, naming table, column and value.
    """
    def typed(n):
        c, column = F.col(f"`{n}`"), spec.require(n, "columns")
        value = parse_text(c, column)
        if not strict or column.kind == "text":
            return value
        wrong = F.raise_error(F.concat(
            F.lit(f"table {spec.name}, column {n}: no {column.label()}: "), c))
        return F.when(c.isNotNull() & value.isNull(), wrong.cast(column.spark_type())).otherwise(value)

    return df.select(*[typed(n).alias(n) for n in df.columns])

