from __future__ import annotations

import itertools
import random

import pytest
from conftest import rows

from probatum.operators import duplicates as D


def frame(spark, data):
    return spark.createDataFrame(data, "id long, a double, b double, y double")


@pytest.mark.parametrize(
    ("labels", "members", "text"),
    [([0, 0], 0, None), ([0, 1], 2, "0:1,1:1"), ([0, 0, 1], 3, "0:2,1:1"), ([0, 0, 1, 1], 4, "0:2,1:2"),
     ([0, 1, None], 3, "0:1,1:1"), ([0, None], 0, None), ([0, 5], 0, None)],
)
@pytest.mark.parametrize("hot", [1_000_000, 1])
def test_conflicts(spark, labels, members, text, hot):
    df = frame(spark, [(i, 1.0, None, None if v is None else float(v)) for i, v in enumerate(labels)])
    got = D.label_conflicts(df, "id", ["a", "b"], "y", [0, 1, 2], hot_rows=hot).collect()
    assert len(got) == members
    if members:
        assert {r.valid_label_counts for r in got} == {text}
        assert {r.n_invalid_or_missing_labels for r in got} == {sum(v is None for v in labels)}


def test_different_features_do_not_conflict(spark):
    assert D.label_conflicts(frame(spark, [(0, 1.0, 1.0, 0.0), (1, 2.0, 1.0, 1.0)]), "id", ["a", "b"], "y", [0, 1]).count() == 0


def skewed(spark, n=90):
    """A third of the rows are copies of one row, another third differ from it in one column."""
    rng = random.Random(1)
    data = []
    for i in range(n):
        if i % 3 == 0:
            data.append((i, 1.0, None, 0.0))
        elif i % 3 == 1:
            data.append((i, 1.0, float(rng.randrange(8)), 0.0))
        else:
            data.append((i, float(rng.randrange(3)), float(rng.randrange(3)), float(rng.randrange(2))))
    return data, frame(spark, data)


def brute_pairs(data):
    return {(x[0], y[0]) for x, y in itertools.combinations(data, 2) if sum(u != v for u, v in zip(x[1:], y[1:])) == 1}


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_near_duplicates_match_brute_force(spark, hot):
    data, df = skewed(spark)
    want = brute_pairs(data)
    feats = ["a", "b", "y"]
    assert sum(r.n_pairs for r in D.near_duplicate_totals(df, "id", feats).collect()) == len(want)
    degree = {}
    for p in want:
        for k in p:
            degree[k] = degree.get(k, 0) + 1
    assert {r.id: r.n_partners for r in D.near_duplicate_degrees(df, "id", feats, hot).collect()} == degree
    value = {r[0]: r[1:] for r in data}
    families = {}
    for r in D.near_duplicate_members(df, "id", feats, hot).collect():
        families.setdefault((r.feature, r.block_id), set()).add(value[r.first_key])
    assert {frozenset((u, v)) for f in families.values() for u in f for v in f if u != v} == {
        frozenset((value[x], value[y])) for x, y in want}


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_groups_match_brute_force(spark, hot):
    data, df = skewed(spark)
    first, size = {}, {}
    for r in data:
        first.setdefault(r[1:], r[0])
        size[r[1:]] = size.get(r[1:], 0) + 1
    got = {r.id: (r.duplicate_group_id, r.group_size) for r in D.feature_groups(df, "id", ["a", "b", "y"], hot).collect()}
    assert got == {r[0]: (first[r[1:]], size[r[1:]]) for r in data}
    dense = {r.id: r.duplicate_group_id for r in D.dense_feature_groups(df, "id", ["a", "b", "y"], hot).collect()}
    key = lambda t: tuple((v is not None, v or 0.0) for v in t)
    rank = {t: i for i, t in enumerate(sorted(size, key=key))}
    assert dense == {r[0]: rank[r[1:]] for r in data}
    dup = {r.id for r in D.duplicate_rows(df, "id", ["a", "b", "y"], hot).collect()}
    assert dup == {r[0] for r in data if size[r[1:]] > 1}
    assert D.has_duplicates(df, ["a", "b", "y"]) and not D.has_duplicates(df.limit(1), ["a"])


def test_audit_bundle(spark):
    raw = spark.createDataFrame([(0, "1", "0"), (1, "1", "0"), (2, "1", "1"), (3, "2", "x")], "id long, a string, y string")
    parsed = raw.selectExpr("id", "try_cast(a as double) a", "try_cast(y as double) y")
    out = D.duplicate_audit(raw, parsed, "id", ["a"], "y", [0, 1, 2])
    assert rows(out["exact_duplicate_rows"]) == [(0,), (1,)]
    assert out["same_features_different_label"].count() == 3
    assert [r.id for r in out["invalid_or_missing_labels"].collect()] == [3]
    assert [r.n_pairs for r in out["near_duplicate_totals"].collect()] == [3]
    assert {(r.value, r.copies) for r in out["near_duplicate_members"].collect()} == {("1.0", 3), ("2.0", 1)}
    assert "near_duplicate_totals" not in D.duplicate_audit(raw, parsed, "id", ["a"], "y", [0, 1, 2], near=False)
