import datetime
import json
from decimal import Decimal

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from tableslice.errors import SpecError
from tableslice.operators.digest import table_digest
from tableslice.operators.objects import (
    manifest_digest, object_manifest, object_violations, sync_plan, unsafe_key, verify_objects,
)
from tableslice.sources.files import (
    read_csv, read_documents, read_jsonl, read_objects, read_per_row, row_slugs, sql_insert_lines,
    write_csv, write_jsonl, write_per_row, write_sql_inserts,
)
from tableslice.spec import ColumnSpec, SliceSpec, TableSpec, UniqueKey, int_col, text_col

SAMPLES = TableSpec("samples", (
    int_col("id", 32), ColumnSpec("exact", "decimal", precision=30, scale=10), int_col("small", 16),
    int_col("big"), ColumnSpec("approx", "float"), ColumnSpec("payload", "bytes"),
    ColumnSpec("at", "timestamp", tz=True), ColumnSpec("wall", "timestamp"), ColumnSpec("day", "date"),
    ColumnSpec("flag", "bool"), ColumnSpec("meta", "json"), text_col("note")), ("id",))
COLS = ("id int, exact decimal(30,10), small smallint, big bigint, approx double, payload binary, "
        "at timestamp, wall timestamp_ntz, day date, flag boolean, meta string, note string")
UTC = datetime.timezone.utc


def samples(spark):
    dst = datetime.datetime(2023, 10, 29, 0, 30, tzinfo=UTC)
    return spark.createDataFrame([
        (1, Decimal("90817263544536271809.0918273645"), -32768, -(2**63), 0.14285714285714285,
         bytearray(b"\x01\x80\x7f\x00\xc3"), dst, datetime.datetime(2018, 6, 5, 4, 3, 2, 10000),
         datetime.date(2000, 2, 29), True, '{"m":[0.10,{"k":null}],"c":{}}', '5" pipe, C:\\temp; it\'s\ton\ntwo lines'),
        (2, Decimal("-0.0000000001"), 32767, 2**63 - 1, float("nan"), bytearray(), dst,
         datetime.datetime(1969, 7, 20, 20, 17, 40), None, False, '"just text"', ""),
        (3, Decimal("0.0000000000"), None, None, float("-inf"), None, None, None, None, None, None, None),
        (4, None, None, None, 1e300, None, None, None, None, None, "3", " ñandú 🚲 ドア\u00a0"),
    ], COLS)


def same(a, b):
    return str(sorted(a.collect())) == str(sorted(b.collect()))


@pytest.mark.parametrize("gz", [None, "gzip"])
def test_jsonl_round_trip(spark, tmp_path, gz):
    df, path = samples(spark), str(tmp_path / "s")
    write_jsonl(df, path, SAMPLES, compression=gz)
    back = read_jsonl(spark, path, SAMPLES)
    assert str(back.orderBy("id").collect()) == str(df.orderBy("id").collect())
    assert table_digest(back, SAMPLES).first() == table_digest(df, SAMPLES).first()


def test_jsonl_lines(spark, tmp_path):
    path = str(tmp_path / "s")
    write_jsonl(samples(spark).select("id", "exact", "approx", "payload", "at", "meta"), path, SAMPLES)
    assert [r["value"] for r in spark.read.text(path).collect()][:3] == [
        '{"id":1,"exact":90817263544536271809.0918273645,"approx":0.14285714285714285,'
        '"payload":"\\\\x01807f00c3","at":"2023-10-29T00:30:00Z","meta":{"m":[0.10,{"k":null}],"c":{}}}',
        '{"id":2,"exact":-0.0000000001,"approx":"NaN","payload":"\\\\x","at":"2023-10-29T00:30:00Z",'
        '"meta":"\\"just text\\""}',
        '{"id":3,"exact":0.0000000000,"approx":"-Infinity","payload":null,"at":null,"meta":null}']


def test_jsonl_missing_unknown_and_swapped(spark, tmp_path):
    spec = TableSpec("t", (int_col("id"), int_col("n"), ColumnSpec("b", "bool"), ColumnSpec("j", "json")), ("id",))
    good = tmp_path / "good.jsonl"
    good.write_text('{"id":1,"n":true,"b":1,"j":"plain"}\n\n{"id":2,"j":"{\\"x\\":1.0}"}\n')
    assert [tuple(r) for r in read_jsonl(spark, str(good), spec).orderBy("id").collect()] == [
        (1, 1, True, '"plain"'), (2, None, None, '{"x":1.0}')]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id":1,"extra":2}\n')
    with pytest.raises(SpecError, match="extra"):
        read_jsonl(spark, str(bad), spec)


def test_csv_round_trip(spark, tmp_path):
    df, path = samples(spark), str(tmp_path / "c")
    write_csv(df, path, SAMPLES)
    assert str(read_csv(spark, path, SAMPLES).orderBy("id").collect()) == str(df.orderBy("id").collect())


def test_csv_errors(spark, tmp_path):
    spec = TableSpec("t", (int_col("id"), text_col("a"), text_col("b")), ("id",))
    f = tmp_path / "x.csv"
    f.write_text('id,a\n1,\n2,""\n')
    assert [tuple(r) for r in read_csv(spark, str(f), spec).orderBy("id").collect()] == [(1, None, None), (2, "", None)]
    f2 = tmp_path / "y.csv"
    f2.write_text("id,nope\n1,2\n")
    with pytest.raises(SpecError, match="nope"):
        read_csv(spark, str(f2), spec)
    f3 = tmp_path / "z.csv"
    f3.write_text("id,a\n1,2,3\n")
    with pytest.raises((PySparkException, Py4JError)):
        read_csv(spark, str(f3), spec).collect()


def test_sql_inserts(spark, tmp_path):
    spec = TableSpec("t", (int_col("id"), text_col("n")), ("id",))
    df = spark.createDataFrame([(3, None), (1, "it's"), (2, "b")], "id long, n string")
    write_sql_inserts(df, str(tmp_path / "q"), spec, SliceSpec("t"), batch=2)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "q")).collect())
    end = 'ON CONFLICT ("id") DO UPDATE SET "n" = EXCLUDED."n";'
    assert text == (
        "INSERT INTO \"t\" (\"id\", \"n\") VALUES\n  (1, 'it''s'::text),\n  (2, 'b'::text) " + end
        + "\nINSERT INTO \"t\" (\"id\", \"n\") VALUES\n  (3, NULL) " + end)
    partial = TableSpec("t", spec.columns, (), (UniqueKey(("id",), "n IS NULL"),))
    lines = sql_insert_lines(df, partial, SliceSpec("t", load="upsert")).collect()
    assert 'ON CONFLICT ("id") WHERE n IS NULL DO UPDATE' in lines[-1]["value"] or any(
        "WHERE n IS NULL" in r["value"] for r in lines)


def test_per_row_files(spark, tmp_path):
    spec = TableSpec("t", (text_col("key"), int_col("n")), ("key",))
    df = spark.createDataFrame([("A b", 1), ("a-b", 2), ("a-b-2", 3), ("é", 4), ("x" * 60, 5)], "key string, n long")
    names = [r["slug"] for r in row_slugs(df, spec).collect()]
    assert len(set(names)) == 5 and {"a-b", "a-b-2", "empty"} <= set(names)
    write_per_row(df, str(tmp_path / "r"), spec)
    assert same(read_per_row(spark, str(tmp_path / "r"), spec), df)
    # A file is named by its row's slug, and nothing else is left there; writing again replaces them.
    assert {f.name for f in (tmp_path / "r").iterdir() if f.suffix == ".json"} == {f"{n}.json" for n in names}
    assert not [f for f in (tmp_path / "r").iterdir() if f.is_dir()]
    write_per_row(df.filter("n <> 1"), str(tmp_path / "r"), spec)
    assert read_per_row(spark, str(tmp_path / "r"), spec).count() == 4
    one = (tmp_path / "r" / "empty.json").read_text()
    assert json.loads(one) == {"key": "é", "n": 4} and one.startswith('{\n  "key": ')


def test_objects(spark, tmp_path):
    root = tmp_path / "bucket"
    (root / "nested" / "deeper").mkdir(parents=True)
    (root / "plain.txt").write_bytes(b"hello")
    (root / "nested/deeper/file.bin").write_bytes(bytes([0, 1, 2, 255, 254]))
    (root / "empty.txt").write_bytes(b"")
    objects = read_objects(spark, str(root))
    manifest = object_manifest(objects)
    got = {r["path"]: (r["size"], r["sha256"][:8]) for r in manifest.collect()}
    assert got["plain.txt"] == (5, "2cf24dba") and got["nested/deeper/file.bin"][0] == 5 and len(got) == 3
    assert [r["path"] for r in object_manifest(read_objects(spark, str(root), "nested")).collect()] == [
        "nested/deeper/file.bin"]
    assert [r["path"] for r in object_violations(objects, 4).orderBy("path").collect()] == [
        "nested/deeper/file.bin", "plain.txt"]
    kept = spark.createDataFrame(manifest.collect(), manifest.schema)
    before = manifest_digest(kept).first()
    (root / "plain.txt").write_bytes(b"hullo")
    (root / "empty.txt").unlink()
    (root / "new.txt").write_bytes(b"n")
    after = read_objects(spark, str(root))
    assert {r["path"]: r["problem"] for r in verify_objects(after, kept).collect()} == {
        "plain.txt": "changed", "empty.txt": "missing", "new.txt": "not in manifest"}
    assert {r["path"]: r["action"] for r in sync_plan(object_manifest(after), kept).collect()} == {
        "plain.txt": "replace", "empty.txt": "drop", "new.txt": "upload"}
    assert manifest_digest(object_manifest(after)).first() != before


def test_unsafe_keys(spark):
    bad = ["", "/abs", "a\0b", "a\\b", "a//b", "a/", "../x", "a/./b"]
    df = spark.createDataFrame([(k,) for k in [*bad, "ok/with space (1).txt", "..x"]], "k string")
    assert {r["k"] for r in df.filter(unsafe_key(df.k).isNotNull()).collect()} == set(bad)


def test_documents_file(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"_id": 1}\n\n{"_id": 2, "x": [1]}\n')
    assert read_documents(spark, str(f)).count() == 2
