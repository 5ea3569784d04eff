from __future__ import annotations

import pytest
from conftest import rows

from probatum.functions.rules import ZERO_LEAK
from probatum.operators import invariance as V
from probatum.operators import permutation as Q


def valid(spark):
    return spark.range(40).selectExpr("id", "cast(id % 3 as int) y", "cast(id % 4 as double) headache",
                                      "cast(id % 5 as double) sleep_quality")


def test_zero_map(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 0, 2)], "headache int, sleep_quality int, y int")
    assert rows(V.zero_leak(df, "y", ZERO_LEAK)) == [(0, 1, 0), (1, 4, 2)]


def test_shuffle_changes_and_keeps_counts(spark):
    df = valid(spark)
    s = V.shuffled_labels(df, "id", "y", 1).persist()
    assert rows(s.groupBy("y").count()) == rows(df.groupBy("y").count())
    assert s.join(df.select("id", df.y.alias("old")), "id").filter("y <> old").count() > 0
    two = spark.createDataFrame([(0, 0), (1, 1)], "id long, y int")
    for seed in range(4):
        assert rows(V.shuffled_labels(two, "id", "y", seed)) == [(0, 1), (1, 0)]


def test_permutations_are_permutations(spark):
    df = valid(spark)
    p = V.permuted_labels(df, "id", "y", 3, 0).persist()
    assert p.select("perm", "id").distinct().count() == 120
    assert rows(p.groupBy("perm", "y").count()) == rows(df.groupBy("y").count().selectExpr(
        "explode(array(0,1,2)) perm", "y", "count"))


def test_invariance_check(spark):
    df = valid(spark)
    V.assert_label_invariance(df, "id", "y", [0, 1, 2], lambda d: d.selectExpr("id", "headache * 2 h"),
                              lambda f: f.selectExpr("id", "cast(h > 2 as int) pred"))
    with pytest.raises(AssertionError, match="leakage"):
        V.assert_label_invariance(df, "id", "y", [0, 1, 2], lambda d: V.zero_leak(d, "y", ZERO_LEAK).drop("y"))


def test_label_checks(spark):
    df = valid(spark)
    with pytest.raises(ValueError, match="illegal label"):
        V.check_labels(df.selectExpr("id", "y + 7 as y"), "y", [0, 1, 2])
    with pytest.raises(ValueError, match="expected 3"):
        V.check_labels(df, "y", [0, 1, 2], 3)


def test_leak_beats_clean_under_permutation(spark):
    df = spark.range(300).selectExpr("id", "cast(hash(id) % 3 as int) h", "cast(id % 2 as double) headache",
                                     "cast(id % 3 as double) noise_level").selectExpr(
        "id", "cast(pmod(h, 3) as int) y", "headache", "noise_level")
    s = Q.permutation_scores(df, "id", "y", ["headache", "noise_level"], [0, 1, 2], ZERO_LEAK, 3).persist()
    assert s.count() == 4 and s.filter("leaky_minus_clean <= 0").count() == 0
    n = {r.series: r for r in Q.null_summary(s).collect()}
    assert n["clean"].share_leaky_gt_clean == 1.0 and n["leaky"]["min"] <= n["leaky"].q05 <= n["leaky"]["max"]
    assert Q.availability(True, False) == ("completed", None)
    assert Q.availability(True, True)[0] == Q.availability(False, False)[0] == "not_available"
