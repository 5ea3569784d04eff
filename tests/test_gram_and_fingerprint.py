from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatum.operators import association as A
from probatum.operators import compare as C


def frame(spark, x):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(5)


def plain(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) == 0 or a.min() == a.max() or b.min() == b.max():
        return None
    return float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_correlations_with_missing_and_constant_columns(spark, shift):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 7))
    x[:, 1] += 2 * x[:, 0]
    x[r.random((400, 7)) < 0.2] = np.nan
    x[:, 3] = 5.0  # constant
    x[:, 4] = np.nan  # never there
    x[:, 5] = np.where(np.isnan(x[:, 0]), x[:, 2], 7.5)  # constant wherever column 0 is there
    x += shift
    got = {(k.a, k.b): k.pearson for k in A.correlations(frame(spark, x), [f"c{i}" for i in range(7)]).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            want = plain(x, i, j)
            assert (got[f"c{i}", f"c{j}"] is None) == (want is None), (i, j)
            assert want is None or abs(got[f"c{i}", f"c{j}"] - want) < 1e-6


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [r.pearson for r in A.correlations(df, ["a", "b"]).collect()] == [None]
    assert all(r.pearson is None for r in A.correlations(df.limit(0), ["a", "b"]).collect())


CELLS = "p string, q string"


def test_fingerprint_ignores_order_only(spark):
    rows = [("x", None), ("x", None), ("y", "1"), (None, "x"), ("", ""), ("ab", "c"), ("a", "bc")]
    a = spark.createDataFrame(rows, CELLS)
    assert C.same_rows(a, spark.createDataFrame(rows[::-1], CELLS).repartition(3), ["p", "q"])
    changes = [rows[1:], rows + rows[:1], [("x", None), *rows[1:-1], ("abc", "")], [(None, "x"), *rows[1:]], [("x", ""), *rows[1:]], [(q, p) for p, q in rows],
               [("x", None)] * 1 + [("y", "1")] * 2 + rows[3:]]
    for other in changes:
        assert not C.same_rows(a, spark.createDataFrame(other, CELLS), ["p", "q"]), other


def test_fingerprint_shuffles_one_record_a_task(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("p"))
    plan = C.fingerprint(df, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan


def test_verdicts(spark):
    a = spark.createDataFrame([("x", None), ("y", "1"), ("y", "1")], CELLS)
    for other, equal, want in [(a, True, "same_rows_same_order"), (a.orderBy("q"), False, "same_rows_different_order"),
                               (a.distinct(), False, "row_or_multiplicity_differences")]:
        summary, details = C.multiset_verdict(a, other, ["p", "q"], equal)
        row = summary.first()
        assert row.status == want and row.same_multiset == (want != "row_or_multiplicity_differences")
        assert details.count() == row.n_distinct_rows_with_count_mismatch == (0 if row.same_multiset else 1)
    assert C.multiset_verdict(a.limit(0), a.limit(0), ["p", "q"], True)[0].first().status == "both_empty"
