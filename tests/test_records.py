"""CSV files in many ranges: borders inside quoted fields, and the same rows as a reader of whole files."""

import csv
import random

import pytest

from tableslice.errors import SpecError
from tableslice.sources.files import read_csv
from tableslice.sources.records import csv_records, range_starts, _lines
from tableslice.spec import TableSpec, int_col, text_col

SPEC = TableSpec("t", (int_col("id"), text_col("a", None), text_col("b", None)), ("id",))


@pytest.fixture
def ranges(spark):
    """Files are read in ranges of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def write(path, rows, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline, quoting=csv.QUOTE_NONNUMERIC)
        w.writerow(["id", "a", "b"])
        w.writerows(rows)


def samples(seed, n, long=3):
    pick = random.Random(seed)
    bits = ["x", "\n", '"', ",", "é", "\r\n", " ", '""', "\n\n", "word", "\r"]
    def text():
        return "".join(pick.choice(bits) for _ in range(pick.randrange(12)))
    rows = [(i, text(), text()) for i in range(n)]
    for i in pick.sample(range(n), long):  # a field over many ranges
        rows[i] = (i, "line\n" * 300, '"' * 7)
    return rows


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_ranges_give_what_a_whole_reader_gives(ranges, tmp_path, newline):
    for k in range(3):
        write(tmp_path / f"{k}.csv", samples(k, 120), newline)
    got = sorted(map(tuple, read_csv(ranges, str(tmp_path), SPEC).collect()))
    assert got == sorted(r for k in range(3) for r in samples(k, 120))


def test_a_file_is_read_by_many_tasks(ranges, tmp_path):
    write(tmp_path / "x.csv", samples(5, 400))
    records = csv_records(ranges, str(tmp_path))
    assert records.rdd.getNumPartitions() > 20
    starts = range_starts(_lines(ranges, str(tmp_path))).collect()
    assert len(starts) > 20 and {r["inside"] for r in starts} == {True, False}
    assert records.count() == 401 and [r["text"] for r in records.filter("top").collect()] == ['"id","a","b"']


def test_a_header_over_a_border(ranges, tmp_path):
    with open(tmp_path / "x.csv", "w") as f:
        f.write('id,a,"' + "b\n" * 400 + '"\n1,x,y\n')
    tops = [r["text"] for r in csv_records(ranges, str(tmp_path)).filter("top").collect()]
    assert tops == ['id,a,"' + "b\n" * 400 + '"']


def test_errors(ranges, tmp_path):
    (tmp_path / "open.csv").write_text('id,a,b\n1,"x,y\n' * 50 + '1,"x\n')
    with pytest.raises(SpecError, match="inside a quoted field"):
        read_csv(ranges, str(tmp_path), SPEC)
    two = tmp_path / "two"
    two.mkdir()
    (two / "1.csv").write_text("id,a,b\n1,x,y\n")
    (two / "2.csv").write_text("id,b,a\n2,x,y\n")
    with pytest.raises(Exception, match="the header of .* is not id, [ab], [ab]"):
        read_csv(ranges, str(two), SPEC).collect()


def test_edges(ranges, tmp_path):
    (tmp_path / "x.csv").write_text('﻿id,a,b\n\n1,,""\n2,"",\n\n', encoding="utf-8")
    got = sorted(map(tuple, read_csv(ranges, str(tmp_path), SPEC).collect()))
    assert got == [(1, None, ""), (2, "", None)]
    only = tmp_path / "only"
    only.mkdir()
    (only / "x.csv").write_text("id,a,b")
    assert read_csv(ranges, str(only), SPEC).count() == 0
