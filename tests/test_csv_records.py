"""Quoted CSV files in parts of a few bytes against a reader of the whole file."""

import csv
import io
import random

import pytest

from tenderloom import fixed_values as fixed
from tenderloom.sources import notices_csv


@pytest.fixture
def tiny_parts(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "50"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)


def written(rng, path, end, mark, rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(fixed.NOTICE_CSV_COLUMNS)
    for row in rows:
        writer.writerow(row)
    path.write_bytes((("﻿" if mark else "") + out.getvalue()).encode())


def cell(rng):
    return rng.choice(["", "a", "예산 안내", 'say "so"', "two\nlines", 'a\n\n"b",\nc', ",", "long " * 30, '"', "x, y", "end\n"])


@pytest.mark.parametrize(("end", "mark"), [("\n", True), ("\r\n", False), ("\n", False)])
def test_records_over_many_parts(tiny_parts, tmp_path, end, mark):
    rng = random.Random(len(end) + mark)
    rows = [[f"n{i}", *[cell(rng) for _ in list(fixed.NOTICE_CSV_COLUMNS)[1:]]] for i in range(40)]
    path = tmp_path / "data.csv"
    written(rng, path, end, mark, rows)
    records = notices_csv.csv_records(tiny_parts, str(path))
    assert records.select("part").distinct().count() > 20
    found = [r["record"] for r in records.orderBy("path", "part", "number").collect()]
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in found] == [list(fixed.NOTICE_CSV_COLUMNS), *rows]
    read = notices_csv.read_notices(tiny_parts, str(path)).orderBy("row_num").collect()
    assert [r["row_num"] for r in read] == list(range(1, 41))
    names = list(fixed.NOTICE_CSV_COLUMNS.values())
    assert [[r[n] for n in names] for r in read] == rows


def test_a_quote_that_is_never_closed(tiny_parts, tmp_path, monkeypatch):
    monkeypatch.setattr(notices_csv, "MOST_RECORD_CHARS", 500)
    path = tmp_path / "open.csv"
    width = len(fixed.NOTICE_CSV_COLUMNS)
    lines = [",".join(fixed.NOTICE_CSV_COLUMNS), *[",".join([f"r{i}"] + ["x"] * (width - 1)) for i in range(5)], '"open', *["more"] * 300]
    path.write_text("\n".join(lines))
    assert [r["row_num"] for r in notices_csv.read_notices(tiny_parts, str(path)).orderBy("row_num").collect()] == [1, 2, 3, 4, 5]


def test_blank_file(tiny_parts, tmp_path):
    path = tmp_path / "blank.csv"
    path.write_text("\n\n")
    assert notices_csv.csv_records(tiny_parts, str(path)).count() == 0
