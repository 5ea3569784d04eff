from __future__ import annotations

import random

import pytest

from probatum.functions.stats import t_quantile
from probatum.operators import metrics as M
from probatum.operators import splits as S


def oof(spark, ys, preds, folds, model="m", repeat=0):
    return spark.createDataFrame(
        [(model, repeat, f, i, y, p) for i, (y, p, f) in enumerate(zip(ys, preds, folds))],
        "model string, repeat int, fold int, id long, y int, pred int")


def reference_macro(ys, preds, labels=(0, 1, 2)):
    out = []
    for c in labels:
        tp = sum(y == c and p == c for y, p in zip(ys, preds))
        den = sum(y == c for y in ys) + sum(p == c for p in preds)
        out.append(2 * tp / den if den else 0.0)
    return sum(out) / len(out)


def test_pooled_and_fold_scores_differ(spark):
    o = oof(spark, [0, 1, 2, 2], [0, 1, 2, 0], [0, 0, 1, 1])
    fold = [r.macro_f1 for r in M.fold_scores(o).orderBy("fold").collect()]
    assert fold == pytest.approx([2 / 3, 2 / 9])
    pooled = M.repeat_scores(o).collect()[0]
    assert pooled.macro_f1 == pytest.approx(7 / 9)
    assert pooled.extreme_error_numerator == 1 and pooled.extreme_error_denominator == 3
    assert pooled.confusion_matrix == [[1, 0, 0], [0, 1, 0], [1, 0, 1]]


def test_scores_recomputed_independently(spark):
    rng = random.Random(0)
    ys = [rng.randrange(3) for _ in range(200)]
    ps = [y if rng.random() < 0.6 else rng.randrange(3) for y in ys]
    fs = [i % 5 for i in range(200)]
    o = oof(spark, ys, ps, fs).persist()
    got = M.repeat_scores(o).collect()[0]
    assert got.macro_f1 == pytest.approx(reference_macro(ys, ps), abs=1e-12)
    assert got.accuracy == pytest.approx(sum(y == p for y, p in zip(ys, ps)) / 200, abs=1e-12)
    folds = M.fold_scores(o).collect()
    for r in folds:
        sub = [(y, p) for y, p, f in zip(ys, ps, fs) if f == r.fold]
        assert r.macro_f1 == pytest.approx(reference_macro(*zip(*sub)), abs=1e-12)
    total = [[sum(r.confusion_matrix[i][j] for r in folds) for j in range(3)] for i in range(3)]
    assert total == got.confusion_matrix


def test_undefined_rates(spark):
    r = M.repeat_scores(oof(spark, [1, 1], [1, 0], [0, 0])).collect()[0]
    assert r.extreme_error_rate is None and r.class_2_f1 == 0.0 and r.class_0_recall == 0.0
    assert r.macro_f1 == pytest.approx((2 / 3) / 3)


def test_single_unit_deviations(spark):
    o = oof(spark, [0, 1, 2, 2], [0, 1, 2, 2], [0] * 4)
    assert M.summarize_scores(M.repeat_scores(o), "repeat").collect()[0].macro_f1_std is None
    assert M.summarize_scores(M.fold_scores(o), "fold").collect()[0].macro_f1_std == 0.0


def test_incomplete_predictions(spark):
    ids = spark.range(3)
    with pytest.raises(ValueError, match="1 of .* rows lack a prediction"):
        M.require_complete(oof(spark, [0, 1, 2], [0, None, 2], [0] * 3), ids, "id", ["m"], 1)
    M.require_complete(oof(spark, [0, 1, 2], [0, 1, 2], [0] * 3), ids, "id", ["m"], 1)
    with pytest.raises(ValueError, match="lack a prediction"):
        M.require_complete(oof(spark, [0, 1, 2], [0, 1, 2], [0] * 3), ids, "id", ["m"], 2)


def test_t_quantile():
    assert t_quantile(0.975, 49) == pytest.approx(2.0095752371292397, abs=1e-12)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-8)
    assert t_quantile(0.975, 2) == pytest.approx(0.95 * (2 / 0.0975) ** 0.5, abs=1e-12)


def test_paired_interval(spark):
    a, b = [0.8, 0.9, 0.7, 0.85], [0.7, 0.9, 0.75, 0.8]
    fs = spark.createDataFrame([(m, 0, i, v) for m, s in (("a", a), ("b", b)) for i, v in enumerate(s)],
                               "model string, repeat int, fold int, macro_f1 double")
    audit = spark.createDataFrame([(0, i, 25, 75) for i in range(4)], "repeat int, fold int, n_valid long, n_train long")
    r = M.paired_comparison(fs, audit, [("a", "b")]).collect()[0]
    d = [x - y for x, y in zip(a, b)]
    mean = sum(d) / 4
    var = sum((x - mean) ** 2 for x in d) / 3
    assert r.mean_diff == pytest.approx(mean) and r.corrected_se == pytest.approx(((1 / 4 + 1 / 3) * var) ** 0.5)
    assert r.df == 3 and r.share_of_folds_a_higher == 0.5
    with pytest.raises(ValueError, match="same folds"):
        M.paired_comparison(fs.filter("not (model = 'b' and fold = 1)"), audit, [("a", "b")])


def test_one_shared_fold_has_no_interval(spark):
    fs = spark.createDataFrame([("a", 0, 0, 0.5), ("b", 0, 0, 0.4)], "model string, repeat int, fold int, macro_f1 double")
    audit = spark.createDataFrame([(0, 0, 25, 75)], "repeat int, fold int, n_valid long, n_train long")
    r = M.paired_comparison(fs, audit, [("a", "b")]).collect()[0]
    assert r.mean_diff == pytest.approx(0.1) and r.df == 0 and r.ci_low is None and r.corrected_se is None
    with pytest.raises(ValueError, match="degree of freedom"):
        t_quantile(0.975, 0)


def test_persistent_errors(spark):
    data = [(m, rep, 0, i, 0, int(i == 0 or (i == 1 and m == "a"))) for m in "ab" for rep in range(5) for i in range(3)]
    o = spark.createDataFrame(data, "model string, repeat int, fold int, id long, y int, pred int")
    got = {r.id: r.persistent_error_all_models for r in M.persistent_errors(o, "id", ["a", "b"]).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_fold_audit_matches_membership(spark):
    f = S.stratified_folds(spark.range(40).selectExpr("id", "cast(id % 3 as int) y"), "id", "y", 4, 1).persist()
    m = S.membership(f, 4).groupBy("fold", "role").count().collect()
    a = {r.fold: r for r in S.fold_audit(f, "y", [0, 1, 2]).collect()}
    assert all(r["count"] == a[r.fold][f"n_{r.role}"] for r in m)


def test_fold_differences(spark):
    rows = [(m, r, f, s) for m, ss in (("a", (0.5, 0.6, 0.7, 0.8)), ("b", (0.4, 0.6, 0.9, 0.8))) for (r, f), s in zip(((0, 0), (0, 1), (1, 0), (1, 1)), ss, strict=True)]
    d = M.fold_differences(spark.createDataFrame(rows, "model string, repeat int, fold int, macro_f1 double"), [("a", "b")])
    got = [(r.repeat, r.fold, round(r["diff"], 9), r.direction) for r in d.orderBy("repeat", "fold").collect()]
    assert got == [(0, 0, 0.1, "a_higher"), (0, 1, 0.0, "equal"), (1, 0, -0.2, "b_higher"), (1, 1, 0.0, "equal")]
