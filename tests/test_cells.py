from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from probatum.functions import cells, rules


def one(spark, expr_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr_of("v")).collect()]


def test_normal_cells_parse(spark):
    assert one(spark, cells.parse_number, ['"14"', "“16”", "0", " 3 ", "'7'"]) == [14, 16, 0, 3, 7]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1e3", 1000.0), ("1_000", None), ("1d", None), ("1f", None), ("0x1p3", None), (".5", 0.5), ("5.", 5.0),
     ("+5", 5.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("nan", None), (" 3", 3.0),
     ("'\"5\"'", None), ("\"'5'\"", 5.0), ("", None), ("abc", None), ("1e", None), (None, None)],
)
def test_number_traps(spark, text, value):
    assert one(spark, cells.parse_number, [text]) == [value]


def test_actions(spark):
    got = one(spark, cells.cell_actions, ["“16”", "Null", ' "5" ', "5", None, " nan "])
    assert got == ["removed_outer_quotes", "null_token_to_missing", "stripped_whitespace;removed_outer_quotes", "",
                   "already_missing", "stripped_whitespace;null_token_to_missing"]
    assert one(spark, cells.normalize_cell, ["Null", "NA", "n/a", "null"]) == [None, None, "n/a", None]


def test_label_reasons(spark):
    v = [None, 1.5, 3.0, 1.0, float("inf"), -1.0, 1e300]
    got = one(spark, lambda c: cells.label_reason(c, "grade", [0, 1, 2]), v, "double")
    assert got[:6] == ["missing_grade", "non_integer_grade", "illegal_grade_3", None, "non_integer_grade",
                       "illegal_grade_-1"]
    assert got[6].startswith("illegal_grade_1000")


def codes(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    allowed = F.lit(None).cast("array<double>") if rule.allowed is None else F.array(*[F.lit(x) for x in rule.allowed])
    c = cells.violation_codes("v", F.lit(rule.lower), F.lit(rule.upper), F.lit(rule.integer_required), allowed)
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_violation_codes(spark):
    r = rules.questionnaire_rules().rules
    assert codes(spark, r["mental_health_history"], [-1.0, 0.5, 2.0, 0.0, 1.0]) == [
        ["below_min", "invalid_category"], ["non_integer", "invalid_category"], ["above_max", "invalid_category"], [], []]
    assert codes(spark, r["headache"], [-2.0, 9.0, None, float("inf")]) == [["below_min"], ["above_max"], [], ["non_finite"]]


def test_rule_set_covers_all_columns():
    r = rules.questionnaire_rules()
    assert len(r.rules) == 21
    assert r.max_of("anxiety_level") == 21 and r.max_of("headache") == 5 and r.max_of("unknown") == 5


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [("1", "1", "equal_raw"), ("1", "1.0", "format_only"), ("", "NaN", "format_only"), ("", "x", "missing_vs_nonmissing"),
     ("1", "9", "numeric_difference"), (" x", "x", "format_only"), ("x", "1", "unparseable"), ("1", "x", "unparseable"),
     ("x", "y", "content_difference"), ("a\r\nb", "a\nb", "format_only"), ("inf", "Infinity", "format_only")],
)
def test_pair_kinds(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(cells.pair_kind("a", "b")).collect()[0][0] == kind


def test_bands_are_half_open(spark):
    got = one(spark, lambda c: cells.band(c, [0, 5, 10], ["lo", "hi"]), [0.0, 4.9, 5.0, 10.0, -1.0, None], "double")
    assert got == ["lo", "lo", "hi", None, None, None]


def test_null_safe_difference(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, None), (3.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(cells.differs("a", "b")).collect()] == [False, False, True, True]


def test_number_text(spark):
    values = [0.0, 1.0, 2.5, 1e7, 12345678.9, 1e15, 1e16, 2.5e20, 1e-3, 5e-4, 1e-5, 1.25e-7, -3e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(cells.number_text(df.v)).collect()] == [repr(v) for v in values]
