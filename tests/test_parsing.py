from __future__ import annotations

import pytest
from conftest import rows

from probatum.functions.rules import questionnaire_rules
from probatum.operators import parsing as P

RULES = questionnaire_rules()
COLS = ["mental_health_history", "headache", "stress_level"]


def parsed(spark, data):
    return spark.createDataFrame(data, "source_row_id long, " + ", ".join(f"{c} double" for c in COLS))


def test_violations_and_counts(spark):
    df = parsed(spark, [(0, -1.0, 0.0, 0.0), (1, 0.5, None, 1.0)])
    v = P.domain_violations(df, "source_row_id", COLS, RULES)
    assert v.filter("source_row_id = 0").count() == 2
    assert {r.violation for r in v.collect()} == {"below_min", "invalid_category", "non_integer"}
    n = P.violation_counts(df, "source_row_id", COLS, RULES).collect()[0]
    assert tuple(n) == (4, 2, 2, 1)
    empty = P.violation_counts(df.limit(0), "source_row_id", COLS, RULES).collect()[0]
    assert tuple(empty) == (0, 0, 0, 0)


def test_field_checks(spark):
    df = parsed(spark, [(0, -1.0, 9.0, 0.0), (1, 0.5, None, 1.0), (2, 1.0, float("inf"), 2.0)])
    by = {r.field: r for r in P.field_checks(df, "source_row_id", COLS, RULES).collect()}
    assert by["headache"].n_above_max == 1 and by["headache"].n_non_finite == 1 and by["headache"].n_missing == 1
    assert by["headache"].n_above_provisional_max == 2
    assert by["mental_health_history"].min == -1.0 and by["mental_health_history"].n_invalid_category == 2


def test_issue_reasons(spark):
    raw = spark.createDataFrame([(0, "“16”"), (1, "Null"), (2, "abc"), (3, None), (4, ' "x" '), (5, "7")], "id long, a string")
    got = {r.id: (r.normalized_value, r.action, r.reason) for r in P.parse_issues(raw, "id", ["a"]).collect()}
    assert got == {
        0: ("16", "removed_outer_quotes", "format_normalized"),
        1: ("", "null_token_to_missing", "null_or_empty_to_missing"),
        2: ("abc", "none", "non_numeric_after_normalization"),
        4: ("x", "stripped_whitespace;removed_outer_quotes", "non_numeric_after_normalization"),
    }


def test_scopes(spark):
    df = parsed(spark, [(0, 0.0, 1.0, 0.0), (1, 0.0, 9.0, 1.0), (2, 0.0, 1.0, None), (3, 0.0, 1.0, 3.0), (4, 9.0, 9.0, 7.0)])
    feats = COLS[:2]

    def got(scope):
        return {r.source_row_id: r.reason for r in P.exclusions(
            df, "source_row_id", "stress_level", [0, 1, 2], feats, RULES, scope).collect()}

    assert got(P.Scope(4)) == {2: "missing_stress_level", 3: "illegal_stress_level_3", 4: P.TAIL_REASON}
    assert got(P.Scope(None, True)) == {1: P.RANGE_REASON, 2: "missing_stress_level", 3: "illegal_stress_level_3",
                                        4: "illegal_stress_level_7"}
    ex = P.exclusions(df, "source_row_id", "stress_level", [0, 1, 2], feats, RULES, P.Scope(None, True))
    assert [r.source_row_id for r in P.included(df, ex, "source_row_id").collect()] == [0]
    assert ex.filter("source_row_id = 1").collect()[0].detail == "headache=9.0 > provisional_max=5.0"


def test_prepare_and_guards(spark):
    raw = spark.createDataFrame([(0, "1", "0"), (1, "x", "1"), (2, "inf", "2"), (3, "1", "")], "id long, a string, y string")
    p = P.prepare(raw, "id", "y", [0, 1, 2], RULES)
    assert rows(p.frame) == [(0, 1.0, 0), (1, None, 1), (2, float("inf"), 2)]
    with pytest.raises(ValueError, match="non-finite value in feature 'a' at row 2"):
        P.check_finite(p.frame, "id", ["a"])
    with pytest.raises(ValueError, match="label"):
        P.check_no_label_in_features(["a", "stress_level_band"], "stress_level")
