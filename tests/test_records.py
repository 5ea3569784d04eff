from __future__ import annotations

import csv
import io
import random

import pytest

from probatum.sources import records, text


@pytest.fixture
def split_at(spark):
    """Files are cut into blocks of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def made(seed, rows=120, end="\n"):
    r = random.Random(seed)
    parts = ["x", "é", ",", '""', "\n", "\r\n", " ", "漢", "\r", " ", "\x0c"]
    out = []
    for k in range(rows):
        cells = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.5:
                cells.append('"' + "".join(r.choice(parts) for _ in range(r.randint(0, 30))) + '"')
            else:
                cells.append("".join(r.choice("abc ") for _ in range(r.randint(0, 9))))
        out.append(",".join([str(k), *cells]))
    return end.join(out)


def plain(data):
    return [r for r in csv.reader(io.StringIO(data, newline="")) if r]


@pytest.mark.parametrize("size", [7, 64, 500, 10_000_000])
@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n\n")])
def test_records_equal_a_plain_reader(spark, tmp_path, split_at, size, seed, end):
    data = made(seed, end=end) + (end if seed > 1 else "")
    (tmp_path / "a.csv").write_bytes(data.encode())
    split_at(size)
    got = sorted(map(tuple, records.read_records(spark, str(tmp_path / "a.csv")).collect()))
    assert [r[0] for r in got] == list(range(len(got)))
    assert [r[2] for r in got] == plain(data)
    assert [r[0] for r in got if r[1]] == [0]


def test_files_in_order_and_one_record_over_many_blocks(spark, tmp_path, split_at):
    files = {"a.csv": 'k,v\n1,"' + "long\n" * 200 + '"\n2,b\n', "b.csv": 'k,v\n3,"open\nto the end\n', "c.csv": 'k,v\n4,d\n"5","e\n"\n'}
    for n, d in files.items():
        (tmp_path / n).write_text(d)
    split_at(50)
    got = sorted(map(tuple, records.read_records(spark, str(tmp_path)).collect()))
    assert [r[2] for r in got] == [r for d in files.values() for r in plain(d)]
    assert [r[0] for r in got if r[1]] == [0, 3, 5]
    raw = text.load_raw_csv(spark, str(tmp_path), "id", multiline=True)
    assert [(r.id, r.k) for r in raw.orderBy("id").collect()] == [(0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5")]


def test_dump_with_short_and_long_rows(spark, tmp_path, split_at):
    (tmp_path / "d.csv").write_text('﻿a,b\n1,"two\nlines"\n3\n\n"",x,extra,,\n')
    split_at(9)
    df, names = text.load_dump(spark, str(tmp_path / "d.csv"), multiline=True)
    assert names == ["a", "b", "__extra_col_0", "__extra_col_1", "__extra_col_2"]
    assert sorted(map(tuple, df.collect())) == [(0, "1", "two\nlines", "", "", ""), (1, "3", "", "", "", ""), (2, "", "x", "extra", "", "")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert records.read_records(spark, str(tmp_path / "e.csv")).count() == 0
    assert text.load_dump(spark, str(tmp_path / "e.csv"), multiline=True)[1] == []
    assert text.load_raw_csv(spark, str(tmp_path / "e.csv"), multiline=True).count() == 0


def test_lines_are_read_in_place(spark, tmp_path, split_at):
    """No row of the file is shuffled: only one record per block, and records that cross blocks."""
    (tmp_path / "f.csv").write_text("k,v\n" + "".join(f'{k},"x\ny"\n' for k in range(3000)))
    split_at(4000)
    found = records.read_records(spark, str(tmp_path / "f.csv"))
    assert found.count() == 3001
    assert found.filter("record > 0 and cast(cells[0] as bigint) <> record - 1").count() == 0
