from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatum.operators import grouping as G
from probatum.operators import invariance as V
from probatum.operators import splits as S
from probatum.operators import trees as T


def h(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def by_rank(keys, k, *prefix):
    """key -> rank * k div n in hash order."""
    order = sorted(keys, key=lambda x: h(*prefix, x))
    return {x: i * k // len(order) for i, x in enumerate(order)}


@pytest.mark.parametrize("digits,most", [(None, 100_000), (1, 100_000), (1, 3), (2, 1), (6, 100_000)])
def test_cuts_stand_at_their_ranks(spark, monkeypatch, digits, most):
    monkeypatch.setattr(G, "CUT_ROWS", most)
    monkeypatch.setattr(G, "PREFIX", 1)
    rows = spark.range(700).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = {r.g: r.cuts for r in G.rank_cuts(rows, ["g"], "h", lambda n: F.array(F.lit(0), n / 2, n - 1, n, n + 5), digits).collect()}
    data = rows.collect()
    for g in {r.g for r in data}:
        hashes = sorted(r.h for r in data if r.g == g)
        assert got[g] == [hashes[0], hashes[len(hashes) // 2], hashes[-1]]


def test_repeated_keys_share_a_place(spark):
    rows = spark.createDataFrame([(1, "aa")] * 40 + [(2, "bb")] * 2, "id int, h string")
    cuts = G.rank_cuts(rows, [], "h", G.even_ranks(4))
    slots = G.between_cuts(rows, [], "h", cuts, "slot").groupBy("h").agg(F.collect_set("slot").alias("s")).collect()
    assert all(len(r.s) == 1 for r in slots)
    assert G.between_cuts(rows.limit(0), [], "h", G.rank_cuts(rows.limit(0), [], "h", G.even_ranks(4)), "slot").count() == 0


def test_fewer_rows_than_folds(spark):
    df = spark.range(3).select("id", F.lit(0).alias("y"))
    got = {(r.repeat, r.id): r.fold for r in S.stratified_folds(df, "id", "y", 5, 2).collect()}
    assert got == {(r, x): f for r in range(2) for x, f in by_rank(range(3), 5, 0, r).items()}
    assert {r.fold for r in S.stratified_folds(df, "id", "y", 1, 1).collect()} == {0}


def test_folds_follow_the_rank(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") < 600, 0).when(F.col("id") < 990, 1).otherwise(F.lit(None)).alias("y"))
    got = {(r.repeat, r.id): r.fold for r in S.stratified_folds(df, "id", "y", 4, 2, 3).collect()}
    for repeat in range(2):
        for ids in (range(600), range(600, 990), range(990, 1003)):
            assert {x: got[repeat, x] for x in ids} == by_rank(ids, 4, 3, repeat)
    inner = S.inner_folds(S.stratified_folds(df, "id", "y", 4, 1).persist(), "id", "y", 4, 3)
    sizes = Counter((r.fold, r.y, r.inner_fold) for r in inner.collect())
    for fold in range(4):
        for y in (0, 1, None):
            c = [sizes[fold, y, i] for i in range(3)]
            assert max(c) - min(c) <= 1


def test_folds_move_no_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    plan = S.stratified_folds(df, "id", "y", 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_permutations_keep_the_counts_and_move_no_rows(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 20, 2).when(F.col("id") < 200, 0).otherwise(1).alias("y"))
    p = V.permuted_labels(df, "id", "y", 20, 1)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    got = p.collect()
    counts = Counter((r.perm, r.y) for r in got)
    assert all(counts[perm, y] == n for perm in range(20) for y, n in ((2, 20), (0, 180), (1, 300)))
    for perm in (0, 7):
        order = sorted(range(500), key=lambda x: h("1:perm", perm, x))
        assert [r.y for x in order for r in got if r.perm == perm and r.id == x] == [0] * 180 + [1] * 300 + [2] * 20
    assert len({tuple(sorted(r.id for r in got if r.perm == k and r.y == 2)) for k in range(20)}) == 20


# trees -------------------------------------------------------------------------------------------

def brute_tree(values, labels, depth=3):
    """Thresholds and predictions of a Gini tree on one feature as (lo, pred), by prefix sums over sorted values."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]

    def grow(v, y, lo, level):
        n = np.bincount(y, minlength=3)
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if level == depth or n.max() == len(y) or not len(cuts):
            return [(lo, int(n.argmax()))]
        one = np.eye(3, dtype=np.int64)[y].cumsum(axis=0)[cuts]
        left, right = one.sum(axis=1), (n - one).sum(axis=1)
        score = (one**2).sum(axis=1) / left + ((n - one) ** 2).sum(axis=1) / right
        at = cuts[np.argmax(score)]
        thr = (v[at] + v[at + 1]) / 2
        return grow(v[: at + 1], y[: at + 1], lo, level + 1) + grow(v[at + 1 :], y[at + 1 :], float(thr), level + 1)

    return grow(v, y, float("-inf"), 0)


def test_trees_on_a_column_of_many_values(spark):
    """150,000 different values: every part is sorted alone, and the trees equal those of a plain fit."""
    n = 150_000
    df = spark.range(n).select(
        F.lit(0).alias("repeat"), (F.col("id") % 3).cast("int").alias("fold"), ((F.col("id") * 7919) % n).cast("double").alias("x"),
        F.pmod(F.xxhash64("id"), F.lit(100)).alias("r"))
    y = F.when(F.col("r") < 25, F.col("r") % 3).when(F.col("x") < 40_000, 0).when(F.col("x") < 90_000, 1).otherwise(2)
    df = df.select("repeat", "fold", "x", y.cast("int").alias("y"))
    grown, scores = T.single_feature_scores(df, ["repeat"], "fold", ["x"], "y", [0, 1, 2])
    data = df.toPandas()
    got = {r.fold: [tuple(x) for x in r.leaves] for r in T.leaves(grown, ["fold"]).collect()}
    for fold in range(3):
        train = data[data.fold != fold]
        assert got[fold] == brute_tree(train.x.to_numpy(), train.y.to_numpy())
    assert grown.filter("v_0 + v_1 + v_2 > 0").count() == n and scores.count() == 3


def test_parts_share_the_work(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(0).alias("repeat"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    hist = T.in_parts(T.value_histogram(df, ["repeat", "fold"], ["x"], "y", [0, 1, 2]))
    sizes = [r["count"] for r in hist.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < n / 2
    ends = hist.groupBy("part").agg(F.min("value").alias("a"), F.max("value").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


def test_running_counts_cross_parts(spark):
    rows = [("f", float(v), v // 3, t, 1 - t) for v, t in enumerate([1, 0, 1, 0, 0, 0, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "feature string, value double, part int, t_0 int, t_1 int").withColumn("t_1", F.lit(0))
    got = {r.value: (r.seen, r.b_t_0, r.nxt) for r in T.counts_below(df, ["feature"], "part", ["t_0", "t_1"]).collect()}
    seen = {v: x for v, x in got.items() if x[0]}
    assert seen == {0: (True, 1, 2), 2: (True, 2, 6), 6: (True, 3, 7), 7: (True, 4, 9), 9: (True, 5, None)}
    assert len(got) == 10


def test_missing_values_go_to_the_mode_or_stay(spark):
    rows = [(0, k % 2, None if k % 4 == 0 else float(k % 3), None, k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "repeat int, fold int, a double, b double, y int")
    grown, scores = T.single_feature_scores(df, ["repeat"], "fold", ["a", "b"], "y", [0, 1, 2])
    got = grown.collect()
    assert all(r.value is not None for r in got if r.feature == "a")
    empty = [r for r in got if r.feature == "b"]
    assert len(empty) == 2 and all(r.value is None and r.node == 0 for r in empty)
    assert {(r.feature, r.fold): r.n_samples for r in scores.collect()} == {(f, k): 30 for f in "ab" for k in range(2)}


def test_rows_are_spread_over_all_cores_before_they_are_multiplied(spark):
    df = spark.range(0, 400, 1, 1).selectExpr("id", "cast(id % 3 as int) y")
    for multiplied in (V.permuted_labels(df, "id", "y", 5), S.stratified_folds(df, "id", "y", 3, 2)):
        assert multiplied.rdd.getNumPartitions() >= 8
        sizes = multiplied.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < multiplied.count() / 4


def test_every_value_is_sorted_once_for_all_folds(spark, monkeypatch):
    n, seen, real = 600, [], T.cut_lineage
    df = spark.range(n).select(F.lit(0).alias("repeat"), (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 10 > 0, F.col("id")).cast("double").alias("x"),
                               F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("y"))

    def counted(made):
        out = real(made)
        seen.append(out.count())
        return out

    monkeypatch.setattr(T, "cut_lineage", counted)
    grown, _ = T.single_feature_scores(df, ["repeat"], "fold", ["x"], "y", [0, 1, 2])
    assert max(seen) <= n and grown.count() == 3 * n * 9 // 10
    data = df.toPandas()
    got = {r.fold: [tuple(x) for x in r.leaves] for r in T.leaves(grown, ["fold"]).collect()}
    for fold in range(3):
        train = data[data.fold != fold]
        assert got[fold] == brute_tree(train.x.fillna(train.x.min()).to_numpy(), train.y.to_numpy())  # all values are equally frequent
