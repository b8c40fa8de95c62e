import datetime
import math
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableslice.functions.canonical import (
    canonicalize, float_text, parse_canonical, parse_failed, parse_text, to_text,
)
from tableslice.functions.jsontext import canonical_json, escape, is_json, render_json
from tableslice.functions.names import closest, csv_field, slug, sql_literal, suggestion
from tableslice.spec import ColumnSpec, TableSpec, int_col, text_col


def texts(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["t"] for r in df.select("i", fn(F.col("v")).alias("t")).orderBy("i").collect()]


def shortest(v):
    """What the shortest round-trip text must be, from Python's own."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    sign, r = ("-" if math.copysign(1, v) < 0 else ""), repr(abs(v))
    m, _, e = r.partition("e")
    w, _, f = m.partition(".")
    point = len(w) + int(e or 0)
    digits = (w + f).lstrip("0")
    point -= len(w + f) - len(digits)
    digits = digits.rstrip("0")
    if not digits:
        return sign + "0"
    n = len(digits)
    if n <= point <= 16:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 16:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{point - 1}"


def test_float_text_is_shortest(spark):
    import random

    rnd = random.Random(7)
    values = [struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] for _ in range(3000)]
    values += [rnd.random() * 10 ** rnd.randint(-9, 22) for _ in range(3000)]
    values += [0.0, -0.0, 1.0, 0.1, 1e7, 1e15, 1e16, 1e23, 2e-3, 1e-5, 9.9e-6, 5e-324,
               8.41e21, float("inf"), float("-inf"), float("nan"), 3.141592653589793]
    assert texts(spark, values, float_text, "double") == [shortest(v) for v in values]


def test_text_of_each_kind(spark):
    row = (True, -5, 0.5, Decimal("1.5000"), bytearray(b"\xde\xad\x00"),
           datetime.date(2024, 2, 29), datetime.datetime(2024, 11, 3, 5, 30, 0, 120000), [1, 2])
    df = spark.createDataFrame(
        [row], "b boolean, i smallint, f float, d decimal(14,4), y binary, "
        "n date, t timestamp_ntz, a array<int>")
    assert canonicalize(df).first().asDict() == {
        "b": "true", "i": "-5", "f": "0.5", "d": "1.5000", "y": "\\xdead00", "n": "2024-02-29",
        "t": "2024-11-03T05:30:00.120000", "a": "[1,2]"}


@pytest.mark.parametrize("kind,good,bad", [
    ("bool", {"t": True, "on": True, "0": False, " no ": False}, ["maybe", "", "YES"]),
    ("int", {"12": 12, " -7 ": -7, "+3": 3}, ["1.5", "", "x", "9223372036854775808"]),
    ("float", {"1e3": 1000.0, ".5": 0.5, "-inf": float("-inf")}, ["1e", "abc", ""]),
    ("decimal", {"1.50": "1.50", "NaN": "NaN", "-1e5": "-1e5"}, ["1e", ".", "1.2.3", ""]),
    ("uuid", {"A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11",
              "a0eebc999c0b4ef8bb6d6bb9bd380a11": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"},
     ["a0eebc99", "g" * 32]),
    ("date", {"2024-02-29": datetime.date(2024, 2, 29), "2024-2-9": datetime.date(2024, 2, 9)},
     ["2024", "2024-02-30", "2024-02-29x"]),
    ("time", {"1:02:03": "01:02:03", "12:34": "12:34:00", "12:34:56.5+02": "12:34:56.500000"},
     ["25:00:00", "12", "1:2:3:4"]),
    ("timestamp", {
        "2024-01-01 12:00:00+05:30": datetime.datetime(2024, 1, 1, 6, 30),
        "2024-01-01T12:00:00.1": datetime.datetime(2024, 1, 1, 12, 0, 0, 100000),
        "2024-01-01": datetime.datetime(2024, 1, 1),
        "2024-11-03 01:30:00-04": datetime.datetime(2024, 11, 3, 5, 30)},
     ["2024-13-01 00:00:00", "noon", "2024-01-01 12"]),
    ("json", {'{"a": 1}': '{"a": 1}', "3": "3"}, ["{a:1}", "", "tru"]),
    ("bytes", {"\\xDEAD": bytearray(b"\xde\xad"), "0x00": bytearray(b"\0"), "ff": bytearray(b"\xff"),
               "": bytearray()}, ["\\xf", "zz"]),
])
def test_parse(spark, kind, good, bad):
    spec = ColumnSpec("v", kind)
    assert texts(spark, list(good), lambda c: parse_text(c, spec)) == list(good.values())
    assert texts(spark, list(bad), lambda c: parse_failed(c, spec)) == [True] * len(bad)
    assert texts(spark, [None], lambda c: parse_failed(c, spec)) == [False]


def test_narrow_integers_are_range_checked(spark):
    assert texts(spark, ["127", "128"], lambda c: parse_text(c, int_col("v", 8))) == [127, None]


def test_parse_inverts_text(spark):
    spec = TableSpec("torture", (
        int_col("id", 32), ColumnSpec("b", "bool"), ColumnSpec("f", "float"),
        ColumnSpec("d", "decimal", precision=30, scale=10), ColumnSpec("y", "bytes"),
        ColumnSpec("n", "date"), ColumnSpec("t", "timestamp"), ColumnSpec("z", "timestamp", tz=True),
        text_col("s")), ("id",))
    at = datetime.datetime(2024, 3, 1, 1, 2, 3, 456789)
    df = spark.createDataFrame([
        (1, True, 3.141592653589793, Decimal("12345678901234567890.1234567890"),
         bytearray(b"\x00\xff"), datetime.date(1999, 12, 31), at, at, ""),
        (2, False, float("nan"), Decimal("-0.0000000001"), bytearray(), None, at, None, " é\n\"'\\"),
        (3, None, None, None, None, None, None, None, None),
    ], "id int, b boolean, f double, d decimal(30,10), y binary, n date, t timestamp_ntz, "
       "z timestamp, s string")
    back = parse_canonical(canonicalize(df, spec), spec)
    assert back.dtypes == df.dtypes
    assert str(sorted(back.collect(), key=lambda r: r["id"])) == str(sorted(df.collect(), key=lambda r: r["id"]))


def test_wide_decimals_keep_their_digits(spark):
    wide = "1" * 45 + ".50"
    assert texts(spark, [wide], lambda c: to_text(parse_text(c, ColumnSpec("v", "decimal")),
                                                  ColumnSpec("v", "decimal"))) == [wide]


def test_canonical_json(spark):
    cases = {
        '{"b": 1.5000, "a": [1, {"d": 1e5, "c": null}]}': '{"a":[1,{"c":null,"d":1e5}],"b":1.5000}',
        '{"n": 123456789012345678901234567890}': '{"n":123456789012345678901234567890}',
        '{"a":1,"a":2}': '{"a":2}', "{}": "{}", '"é"': '"é"', "not json": "not json",
    }
    assert texts(spark, list(cases), canonical_json) == list(cases.values())
    assert texts(spark, ["1", "[", None], is_json) == [True, False, None]
    assert render_json('{"b":[],"a":{"x":1}}', 2) == '{\n  "a": {\n    "x": 1\n  },\n  "b": []\n}'
    assert render_json("NaN") is None


def test_escape(spark):
    assert texts(spark, ['a"\\\n\r\t\b\f\x01\x1fé', "plain"], escape) == [
        'a\\"\\\\\\n\\r\\t\\b\\f\\u0001\\u001fé', "plain"]


def test_slug(spark):
    got = texts(spark, [None, "", "Hello  World!", "2024-01-01 12:00:00", "é", "x" * 60], slug)
    assert got[:5] == ["null", "empty", "hello-world", "2024-01-01-12-00-00", "empty"]
    assert got[5].startswith("x" * 40 + "-") and len(got[5]) == 49


def test_sql_literal(spark):
    def lit(values, kind, **kw):
        return texts(spark, values, lambda c: sql_literal(c, ColumnSpec("v", kind, **kw)))

    assert lit(["it's", None], "text") == ["'it''s'::text", "NULL"]
    assert lit(["1.50", "NaN", "1e5"], "decimal") == ["1.50", "'NaN'::numeric", "'1e5'::numeric"]
    assert lit(["true"], "bool") == ["TRUE"]
    assert lit(["1.5", "Infinity"], "float") == ["1.5", "'Infinity'::double precision"]
    assert lit(["\\x00"], "bytes") == ["'\\x00'::bytea"]


def test_csv_field(spark):
    assert texts(spark, [None, "", "a", "a,b", 'q"q', " pad", "l\nm"], csv_field) == [
        "", '""', "a", '"a,b"', '"q""q"', '" pad"', '"l\nm"']


def test_suggestions(spark):
    known = ["users", "orders", "order_items"]
    assert texts(spark, ["user", "ordres", "zzz"], lambda c: suggestion(c, known)) == [
        "users", "orders", None]
    assert closest("oders", known) == "orders" and closest("zzz", known) is None
