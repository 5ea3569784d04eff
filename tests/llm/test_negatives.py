from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from probatum.llm import negatives, queries

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives_=5, percent=80):
    clean = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            clean.append((k, i, label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)))
    out = []
    for k, i, label, v in clean:
        if is_anchor(i):
            others = sorted((-int(v @ x), j, m, y) for m, j, y, x in clean if m != k and len(x) == len(v))
            for s, j, m, _ in [o for o in others if o[3] == label][:positives]:
                p = -s
                band = [o for o in others if o[3] != label and percent * p <= -100 * o[0] <= 100 * p][:negatives_]
                out += [(i, j, n + 1, o[1], p, -o[0]) for n, o in enumerate(band)]
    return sorted(out)


def sample(seed, n=400, d=8, groups=6, noise=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    rows = []
    for k in range(n):
        v = centres[r.integers(groups)] + noise * r.normal(size=d)
        rows.append((k, [float(x) for x in v], int(r.integers(3))))
    return rows


def mined(spark, rows, step=10):
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % step == 0)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("blocks", [False, True])
def test_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:  # many blocks, clusters and steps
        for name, value in {"VALUES": 400, "ANCHORS": 16, "MEMBERS": 4, "STRIDE": 3}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = sample(1)
    rows += [(i, [float(x) for x in v], label) for i, v, label in rows[:60]]  # repeated ids, ties
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(80)]  # one common vector
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [float("nan")] * 8, 0), (2030, [float("inf")] * 8, 0), (None, rows[0][1], 1),
             (2040, rows[1][1], None), (2050, [], 1), (2060, [0.0] * 8, 1), (2070, [0.0] * 8, 2), (2080, [1.0, 2.0], 1), (2090, [1.0, 2.0], 1), (2091, [1.0, 1.9], 2)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert any(x[0] == 2090 for x in got) and len(got) > 500


def test_lists_bound_every_score():
    r = np.random.default_rng(3)
    anchors, others = np.floor(50 * r.normal(size=(200, 6))), np.floor(50 * r.normal(size=(500, 6)))
    others[:50] = anchors[:50]
    norms = np.linalg.norm(anchors, axis=1)
    seen = 0
    for members, order, bound in negatives.shared_lists(anchors, others):
        seen += len(members)
        scores = anchors[members] @ others[order].T
        assert (np.diff(bound) <= 0).all()
        assert (scores <= norms[members][:, None] * bound[None, :] + negatives.SLACK * norms[members][:, None] * np.linalg.norm(others, axis=1).max() + 1e-9).all()
    assert seen == 200


def test_walks_end_early_on_clustered_vectors(monkeypatch):
    rows = sample(7, n=4000, d=16, groups=8, noise=0.05)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    scored = []
    real = negatives.Kept.take
    monkeypatch.setattr(negatives.Kept, "take", lambda self, s, i, r: scored.append(len(s)) or real(self, s, i, r))
    monkeypatch.setattr(negatives, "STRIDE", 64)
    ids = np.arange(len(x))
    results = [[negatives.Kept(5)] for _ in range(128)]
    negatives.walk(x[:128], ids[:128], x, ids, ids, results)
    assert sum(scored) < 0.6 * 128 * len(x)
    scores = x[:128] @ x.T
    scores[np.arange(128), np.arange(128)] = -np.inf
    assert all(r.ids.tolist() == np.lexsort((ids, -s))[:5].tolist() for (r,), s in zip(results, scores, strict=True))


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 1.0078125], 1), (2, [3e5, 1.00390625], 2), (3, [3e5, 1.0], 2), (4, [2e5, 7.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables(spark):
    df = spark.createDataFrame([], VECTORS + ", `Score` int")
    assert negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_query_relabels_every_seventh(spark, tmp_path):
    rows = [(k, v, label) for k, v, label in sample(9, n=700)]
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    told = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute(told, lambda i: i % 100 == 0) and got
