from __future__ import annotations

import json

import pytest

from probatum.operators import compare as C
from probatum.plans import dump
from probatum.sources import sinks

BASE = "a,b\n1,x\n2,y\n3,z\n"


def run(spark, tmp_path, cand, ref=BASE, **kw):
    for n, t in (("c", cand), ("r", ref)):
        (tmp_path / f"{n}.csv").write_bytes(t.encode())
    out = str(tmp_path / "out")
    kw.setdefault("prefix_rows", 1100)
    return dump.compare_files(spark, str(tmp_path / "c.csv"), str(tmp_path / "r.csv"), out, **kw), out


CASES = {
    "exact": (BASE, {"exact_file_match": True, "full_table_raw_match": True, "content_differences": False}),
    "crlf": (BASE.replace("\n", "\r\n"), {"exact_file_match": False, "normalized_file_match": True,
                                          "full_table_raw_match": True}),
    "number_format": (BASE.replace("1,", "1.0,"), {"full_table_raw_match": False, "full_table_format_match": True,
                                                    "content_differences": False}),
    "column_order": ("b,a\nx,1\ny,2\nz,3\n", {"column_order_differs": True, "full_table_raw_match": True}),
    "row_order": ("a,b\n2,y\n1,x\n3,z\n", {"full_same_rows_different_order": True, "full_table_raw_match": False,
                                           "content_differences": True}),
    "missing": ("a,b\n,x\n2,y\n3,z\n", {"content_differences": True, "full_table_format_match": False}),
    "number": ("a,b\n9,x\n2,y\n3,z\n", {"content_differences": True}),
    "other_column": ("a,c\n1,x\n2,y\n3,z\n", {"content_differences": True, "not_comparable": False}),
    "nothing_shared": ("q\n1\n", {"not_comparable": True}),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_statuses(spark, tmp_path, case):
    text, want = CASES[case]
    report, out = run(spark, tmp_path, text)
    got = report["statuses"]
    assert {k: got[k] for k in want} == want
    assert sinks.read_status(spark, out) == "completed"
    if case == "exact":
        doc = json.loads(spark.read.text(f"{out}/comparison").collect()[0].value)
        assert doc["layers"]["full"]["multiset"]["status"] == "same_rows_same_order"
        with pytest.raises(sinks.OutputError):
            run(spark, tmp_path, text)


def test_prefix_and_lengths(spark, tmp_path):
    report, _ = run(spark, tmp_path, "a,b\n1,x\n2,y\n", prefix_rows=2)
    assert report["statuses"]["prefix_raw_match"] and not report["statuses"]["full_table_raw_match"]
    full = report["layers"]["full"]
    assert not full["comparable"] and full["multiset"]["status"] == "row_or_multiplicity_differences"
    assert full["multiset"]["n_distinct_rows_with_count_mismatch"] == 1


def test_short_prefix_is_not_comparable(spark, tmp_path):
    report, _ = run(spark, tmp_path, BASE)
    assert report["layers"]["prefix"]["multiset"]["status"] == "not_comparable"


def test_details_are_whole(spark):
    a = spark.range(50).selectExpr("id row_index", "cast(id as string) v")
    b = spark.range(50).selectExpr("id row_index", "cast(id + 1 as string) v")
    report, tables = dump.compare_dumps(a, b, ["v"], ["v"], prefix_rows=10)
    full = report["layers"]["full"]
    assert full["counts"]["numeric_difference"] == 50 and full["n_difference_rows_written"] == 50
    assert [r.row_index for r in tables["cell_differences_full"].collect()] == list(range(50))


def test_multiset_counts(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", "1")], "p string, q string")
    b = spark.createDataFrame([("x", None), ("y", "1")], "p string, q string")
    m = C.multiset(a, b, ["p", "q"])
    assert [tuple(r) for r in C.multiset_details(m, ["p", "q"]).collect()] == [("x", None, 2, 1)]
    assert not C.same_rows(a, b, ["p", "q"]) and C.same_rows(b, b, ["q", "p"])
