"""Feature-label association: cross tables, purity, correlations, counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators.parsing import long_cells


def crosstab(df: DataFrame, feature: str, label: str, labels: Sequence[int]) -> DataFrame:
    """Value by label counts with fixed label columns; missing feature values are dropped."""
    return (
        df.filter(F.col(feature).isNotNull())
        .groupBy(F.col(feature).alias("value"))
        .agg(*[F.count_if(F.col(label) == lab).alias(f"label_{lab}") for lab in labels])
    )


def label_purity(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: distinct values, and the share of all rows whose value occurs with one label only.

    Missing rows count as not pure. A value is pure iff its smallest and largest label agree, so one
    combined aggregate per (feature, value) replaces a distinct count of labels.
    """
    by_value = (
        df.select(key, label, *features)
        .unpivot([key, label], list(features), "feature", "value")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    )
    pure = F.col("value").isNotNull() & (F.col("lo") == F.col("hi"))
    return by_value.groupBy("feature").agg(
        F.count("value").alias("n_values"),
        (F.coalesce(F.sum(F.when(pure, F.col("n"))), F.lit(0)) / F.sum("n")).alias("pure_row_share"),
    )


def purity_report(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """Purity in descending order, ties by feature name. One row per feature."""
    return label_purity(df, key, features, label).orderBy(F.desc("pure_row_share"), "feature")


GRAM = ("n", "sa", "sb", "qa", "qb", "p")  # of a pair: rows, sums, sums of squares, sum of products
ENDS = ("la", "ha", "lb", "hb")  # and smallest and largest values


def gram(batches: Iterator[pa.RecordBatch], pivot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of one partition for every pair of columns, over the rows where both are present; values less ``pivot``.

    Blocks of rows meet as matrices, so that a pair costs a few multiplications a row and no aggregate buffer.
    """
    d = len(pivot)
    sums = np.zeros((4, d, d))  # [0] rows, [1] x_i, [2] x_i squared where j is present, [3] x_i * x_j
    low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
    for batch in batches:
        raw = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
        for x in np.array_split(raw, max(1, len(raw) // 8_192)):
            here = ~np.isnan(x)
            mask = here.astype(float)
            v = np.where(here, x - pivot, 0.0)
            sums += np.stack([mask.T @ mask, v.T @ mask, (v * v).T @ mask, v.T @ v])
            whole = here.all(axis=0)
            if len(x):
                small, large = np.where(here, x, np.inf), np.where(here, x, -np.inf)
                low[:, whole] = np.minimum(low[:, whole], small.min(axis=0)[:, None])
                high[:, whole] = np.maximum(high[:, whole], large.max(axis=0)[:, None])
                for j in np.flatnonzero(~whole & here.any(axis=0)):
                    low[:, j] = np.minimum(low[:, j], small[here[:, j]].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], large[here[:, j]].max(axis=0))
    i, j = np.triu_indices(d, 1)
    n, s, q, p = sums
    parts = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j], low[i, j], high[i, j], low[j, i], high[j, i]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["i", "j", *GRAM, *ENDS])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, pearson) for every pair of columns, over rows where both are present; NULL where it is undefined.

    Every task makes one record per pair, which are summed; nothing else is shuffled. Values are taken less the mean of some
    rows, which shifts no correlation and keeps the digits of columns far from zero.
    """
    names = list(columns)
    wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(names)])
    some = wide.limit(1_000).agg(*[F.avg(c).alias(c) for c in wide.columns]).first()
    pivot = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in some])
    kind = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in (*GRAM, *ENDS))
    parts = wide.mapInArrow(lambda batches: gram(batches, pivot), kind)
    one = parts.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in GRAM], F.min("la").alias("la"), F.max("ha").alias("ha"), F.min("lb").alias("lb"), F.max("hb").alias("hb"))

    def spread(s: str, q: str) -> Column:
        return F.greatest(F.col("n") * F.col(q) - F.col(s) * F.col(s), F.lit(0.0))

    pearson = F.try_divide(F.col("n") * F.col("p") - F.col("sa") * F.col("sb"), F.sqrt(spread("sa", "qa")) * F.sqrt(spread("sb", "qb")))
    varies = (F.col("n") > 0) & (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    name = F.array(*[F.lit(c) for c in names])
    return one.select(
        F.get(name, F.col("i").cast("int")).alias("a"), F.get(name, F.col("j").cast("int")).alias("b"),
        F.when(varies & ~F.isnan(pearson), F.greatest(F.least(pearson, F.lit(1.0)), F.lit(-1.0))).alias("pearson"))


def mean_abs_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute off-diagonal correlation, undefined pairs skipped."""
    return correlations(df, columns).agg(F.avg(F.abs("pearson")).alias("mean_abs_correlation"))


def value_counts(df: DataFrame, column: Column | str, name: str = "value") -> DataFrame:
    """Rows per value, missing included."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def all_value_counts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return long_cells(df, key, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
