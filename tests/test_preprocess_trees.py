from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from probatum.operators import preprocess as R
from probatum.operators import splits as S
from probatum.operators import trees as T


def test_train_median_ignores_validation(spark):
    d = [(0, 1, 1.0, 10.0), (0, 1, 2.0, 20.0), (0, 1, None, 30.0), (0, 0, 1000.0, None)]
    df = spark.createDataFrame(d, "repeat int, fold int, x double, y double")
    p = R.parameters(R.train_statistics(df, ["x", "y"]))[(0, 0)]
    assert p["x"][0] == 1.5 and p["y"][0] == 20.0
    valid = df.filter("fold = 0").select(*R.impute(["x", "y"], p)).collect()[0]
    assert tuple(valid) == (1000.0, 20.0)
    assert R.fit_statistics(df.filter("fold = 1").select("x", "y"), ["x", "y"])["x"][0] == 1.5


def test_scaling_uses_training_rows_only(spark):
    def params(extreme):
        d = [(0, 1, 0.0), (0, 1, 1.0), (0, 1, None), (0, 0, extreme)]
        return R.parameters(R.train_statistics(spark.createDataFrame(d, "repeat int, fold int, a double"), ["a"]))[(0, 0)]

    assert params(999.0) == params(0.0)
    med, mean, std = params(999.0)["a"]
    assert (med, mean) == (0.5, 0.5) and std == pytest.approx(statistics.pstdev([0, 1, 0.5]))


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(0, i % 2, 3.0) for i in range(6)], "repeat int, fold int, a double")
    assert {v["a"] for v in R.parameters(R.train_statistics(df, ["a"])).values()} == {(3.0, 3.0, 1.0)}


def test_empty_training_column_is_an_error(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, None, 2.0)], "repeat int, fold int, a double, b double")
    p = R.parameters(R.train_statistics(df, ["a", "b"]))
    with pytest.raises(ValueError, match="without any value"):
        R.impute(["a", "b"], p[(0, 0)])


def test_quantile_equals_sorting(spark):
    rng = random.Random(3)
    data = [(r, f, 5.0 if rng.random() < 0.34 else rng.gauss(0, 100) ** 3, None if rng.random() < 0.2 else rng.random())
            for r in range(2) for f in range(3) for _ in range(400)]
    df = spark.createDataFrame(data, "repeat int, fold int, a double, b double")
    small = {(r.feature, r["repeat"], r.fold): r.median for r in R.train_medians(df, ["a", "b"]).collect()}
    for (c, rep, fold), m in small.items():
        col = [d[2 if c == "a" else 3] for d in data if d[0] == rep and d[1] != fold]
        assert m == pytest.approx(statistics.median([v for v in col if v is not None]))


def gini_tree(train, labels, depth):
    """Brute-force depth-limited tree on (value, label) pairs; returns a predict function."""
    counts = [sum(y == c for _, y in train) for c in labels]
    best_label = labels[max(range(len(labels)), key=lambda i: (counts[i], -i))]
    values = sorted({v for v, _ in train})
    if depth == 0 or max(counts) == len(train) or len(values) < 2:
        return lambda x: best_label
    best = None
    for a, b in zip(values, values[1:]):
        left = [y for v, y in train if v <= a]
        right = [y for v, y in train if v > a]
        score = sum(left.count(c) ** 2 for c in labels) / len(left) + sum(right.count(c) ** 2 for c in labels) / len(right)
        if best is None or score > best[0]:
            best = (score, (a + b) / 2)
    thr = best[1]
    lo = gini_tree([t for t in train if t[0] <= thr], labels, depth - 1)
    hi = gini_tree([t for t in train if t[0] > thr], labels, depth - 1)
    return lambda x: lo(x) if x <= thr else hi(x)


@pytest.mark.parametrize("seed", [0, 1])
def test_trees_match_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(120):
        y = rng.randrange(3)
        data.append((0, i % 3, i, y, None if rng.random() < 0.1 else float(y * 2 + rng.randrange(5)), float(rng.randrange(9))))
    df = spark.createDataFrame(data, "repeat int, fold int, id long, y int, a double, b double").persist()
    grown, _ = T.single_feature_scores(df, ["repeat"], "fold", ["a", "b"], "y", [0, 1, 2])
    got = {(r.fold, r.feature, r.value): r.pred for r in grown.collect()}
    assert len(got) > 40
    for fold in range(3):
        for col, name in ((4, "a"), (5, "b")):
            train = [(d[col], d[3]) for d in data if d[1] != fold]
            seen = [v for v, _ in train if v is not None]
            mode = min(set(seen), key=lambda v: (-seen.count(v), v))
            tree = gini_tree([(mode if v is None else v, y) for v, y in train], [0, 1, 2], 3)
            for (f, n, v), p in got.items():
                if (f, n) == (fold, name):
                    assert p == tree(v), (f, n, v)


def test_nested_single_picks_the_informative_feature(spark):
    df = spark.range(240).selectExpr("id", "cast(id % 3 as int) y", "cast(id % 3 * 2 + (id div 3) % 2 as double) good",
                                     "cast(hash(id) % 11 as double) noise")
    f = S.stratified_folds(df, "id", "y", 3, 2).persist()
    inner = S.inner_folds(f, "id", "y", 3, 3)
    feats = df.drop("y")
    o, cand, picks = T.nested_single(f.join(feats, "id"), inner.join(feats, "id"), "id", ["noise", "good"], "y", [0, 1, 2])
    assert {r.feature for r in picks.collect()} == {"good"}
    assert o.count() == 480 and o.filter("y <> pred").count() == 0
    assert cand.count() == 12


def test_tie_breaks(spark):
    c = spark.createDataFrame([(0, "b", .8), (0, "a", .8), (1, "b", .9), (1, "a", .5)], "g int, feature string, s double")
    assert {r.g: r.feature for r in T.best_feature(c, ["g"], "s").collect()} == {0: "a", 1: "b"}
    p = spark.createDataFrame([(0, 0, .8), (0, 2, .8), (1, 0, .7), (1, 5, .9), (2, 2, .81), (2, 6, .81)],
                              "g int, priority int, s double")
    assert {r.g: r.priority for r in T.best_priority(p, ["g"], "s", "priority").collect()} == {0: 0, 1: 5, 2: 2}
