from __future__ import annotations

import hashlib

import pytest
from conftest import rows

from probatum.sources import sinks, text


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_raw_csv_keeps_text(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'a,b\n"14",NA\n 3 ,Null\n"x,y",\n')
    assert rows(text.load_raw_csv(spark, p)) == [(0, "14", None), (1, " 3 ", "Null"), (2, "x,y", None)]


def test_row_index_follows_the_file_over_many_blocks(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    n = 0
    for f in range(3):
        lines = [f"{n + i},{'x' * (i % 50)}" for i in range(3000)]
        n += 3000
        write(d / f"p{f}.csv", "k,v\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = text.load_raw_csv(spark, str(d))
        assert df.filter("source_row_id <> cast(k as bigint)").count() == 0
        assert df.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dump_reader(spark, tmp_path):
    p = write(tmp_path / "d.csv", '﻿a,b\n1,"two\nlines"\n3\n"",x,extra\n')
    df, names = text.load_dump(spark, p, multiline=True)
    assert names == ["a", "b", "__extra_col_0"]
    assert rows(df) == [(0, "1", "two\nlines", ""), (1, "3", "", ""), (2, "", "x", "extra")]


def test_dump_reader_keeps_cells_behind_gaps(spark, tmp_path):
    p = write(tmp_path / "d.csv", "a,b\n1,2\n3,4" + "," * 9 + "kept\n5\n\"6,x\",7,\n")
    df, names = text.load_dump(spark, p)
    assert names == ["a", "b", *[f"__extra_col_{i}" for i in range(9)]]
    assert rows(df) == [(0, "1", "2", *[""] * 9), (1, "3", "4", *[""] * 8, "kept"), (2, "5", *[""] * 10), (3, "6,x", "7", *[""] * 9)]


def test_digests(spark, tmp_path):
    crlf, lf = bytes(range(256)) + b"a\r\nb\rc\n", bytes(range(13)) + b"\n" + bytes(range(14, 256)) + b"a\nb\nc\n"
    p, q = write(tmp_path / "p.bin", crlf), write(tmp_path / "q.bin", lf)
    a, b = (text.file_digests(spark, x).collect() for x in (p, q))
    assert a[0].raw_sha256 == hashlib.sha256(crlf).hexdigest() and a[0].nbytes == len(crlf)
    assert a[0].lf_sha256 == b[0].lf_sha256 == hashlib.sha256(lf).hexdigest()
    text.require_unchanged(a, text.file_digests(spark, p))
    write(tmp_path / "p.bin", b"other")
    with pytest.raises(RuntimeError, match="changed"):
        text.require_unchanged(a, text.file_digests(spark, p))


def test_strong_features(spark, tmp_path):
    p = write(tmp_path / "r.json", '{"scores": {"a": 0.9, "b": 0.85, "c": 0.1}, "other": 1}')
    assert rows(text.strong_features(spark, p, "scores")) == [("a", 0.9), ("b", 0.85)]


def test_output_is_never_overwritten(spark, tmp_path):
    out = tmp_path / "run"
    sinks.claim_output(spark, str(out))
    assert sinks.read_status(spark, str(out)) == "in_progress"
    with pytest.raises(sinks.OutputError, match="already"):
        sinks.claim_output(spark, str(out))
    sinks.write_status(spark, str(out), "completed")
    assert sinks.read_status(spark, str(out)) == "completed"
    with pytest.raises(sinks.OutputError, match="is a file"):
        sinks.claim_output(spark, write(tmp_path / "f", "x"))
    df = spark.sql("select 1 a, array(array(1, 2)) m")
    sinks.write_table(df, str(out / "t"))
    assert spark.read.option("header", True).csv(str(out / "t")).collect()[0].m == "[[1,2]]"
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(df, str(out / "t"))
