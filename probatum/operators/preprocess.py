"""Train-only imputation and scaling statistics for all folds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.session import cut_lineage

PARTS = 512  # ordered parts of a column's values


def train_histogram(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, repeat, fold, n): value counts of every fold's training part.

    Counted once per validation fold; the training count is the repeat's total minus the fold's own, so
    rows are not expanded to their k-1 training roles.
    """
    # read twice by the quantiles and once for the folds; missing values keep every fold present
    counted = cut_lineage(
        assigned.select("repeat", "fold", *features)
        .unpivot(["repeat", "fold"], list(features), "feature", "value")
        .groupBy("feature", "value", "repeat", "fold")
        .agg(F.count(F.lit(1)).alias("nv"))
    )
    folds = counted.select("repeat", "fold").distinct()
    valid = counted.filter(F.col("value").isNotNull())
    # per (feature, value, repeat): at most k fold counts
    total = valid.groupBy("feature", "value", "repeat").agg(
        F.sum("nv").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "nv"))).alias("own")
    )
    # repeats x folds rows, fixed by the caller
    wide = total.join(F.broadcast(folds), "repeat")
    n = F.col("total") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))
    return wide.select("feature", "value", "repeat", "fold", n.alias("n")).filter(F.col("n") > 0)


def exact_quantile(hist: DataFrame, keys: Sequence[str], split_key: str, prob: float, out: str) -> DataFrame:
    """Exact interpolated quantile of a (keys, value, n) histogram.

    Values are cut into ordered parts at approximate quantiles gathered per ``split_key``; part totals locate
    the part holding each rank, and only that part is sorted. The parts decide the work, never the result.
    """
    edges = hist.groupBy(split_key).agg(
        F.percentile_approx("value", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 10000).alias("cuts"),
    ).collect()  # one row of PARTS numbers per column of the table
    part: Column = F.lit(0)
    for r in edges:
        cuts = sorted(set(r.cuts))
        arr = F.array(*[F.lit(float(c)) for c in cuts])
        part = F.when(F.col(split_key) == r[split_key], F.size(F.filter(arr, lambda c: c < F.col("value")))).otherwise(part)
    h = hist.withColumn("__part", part)
    sums = h.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    at = (F.sum("__n").over(whole) - 1) * F.lit(prob)
    sums = sums.select(*keys, "__part", "__n", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), at.alias("__at"))
    lo, hi = F.floor("__at"), F.ceil("__at")
    covers = (lo < F.col("__before") + F.col("__n")) & (hi >= F.col("__before"))
    picked = h.join(sums.filter(covers).drop("__n"), [*keys, "__part"])
    inner = Window.partitionBy(*keys, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    picked = picked.withColumn("__start", start)
    inside = lambda rank: (rank >= F.col("__start")) & (rank < F.col("__start") + F.col("n"))
    ends = picked.groupBy(*keys).agg(
        F.max(F.when(inside(lo), F.col("value"))).alias("a"), F.max(F.when(inside(hi), F.col("value"))).alias("b"),
        F.first("__at").alias("at"),
    )
    share = F.col("at") - F.floor("at")
    value = F.when(share == 0, F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + share * F.col("b"))
    return ends.select(*keys, value.alias(out))


def train_medians(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, repeat, fold, median) over each training part, missing values ignored."""
    h = train_histogram(assigned, features)
    return exact_quantile(h, ["feature", "repeat", "fold"], "feature", 0.5, "median")


def train_modes(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, repeat, fold, mode): most frequent training value, the smallest on ties."""
    return train_histogram(assigned, features).groupBy("feature", "repeat", "fold").agg(
        F.max_by("value", F.struct("n", -F.col("value"))).alias("mode")
    )


def train_statistics(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, repeat, fold, median, mean, std): imputation and scaling parameters of every training part.

    Mean and population deviation are those of the imputed column, merged from per-fold moments (count,
    mean, squared deviations, missing) with the missing cells standing at the median. Zero deviation
    scales by 1.
    """
    parts = (
        assigned.select("repeat", "fold", *features)
        .unpivot(["repeat", "fold"], list(features), "feature", "value")
        .groupBy("feature", "repeat", "fold")
        .agg(
            F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("miss"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"),
        )
    )
    med = train_medians(assigned, features)
    # features x repeats x folds rows from here on
    own = parts.select("feature", "repeat", F.col("fold").alias("__f"), "n", "miss", "m", "v")
    train = med.join(own, ["feature", "repeat"]).filter(F.col("fold") != F.col("__f"))
    g = train.groupBy("feature", "repeat", "fold", "median").agg(
        F.sum("n").alias("n"), F.sum("miss").alias("miss"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.collect_list(F.struct("n", "m", "v")).alias("ps"),
    )
    size = F.col("n") + F.col("miss")
    mean = (F.col("s") + F.col("miss") * F.col("median")) / size
    g = g.withColumn("mean", mean)
    sq = F.aggregate(
        "ps", F.lit(0.0), lambda a, p: a + p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    ) + F.col("miss") * (F.col("median") - F.col("mean")) * (F.col("median") - F.col("mean"))
    std = F.sqrt(sq / size)
    return g.select("feature", "repeat", "fold", "median", "mean", F.when(std > 0, std).otherwise(1.0).alias("std"))


def parameters(stats: DataFrame) -> dict[tuple[int, int], dict[str, tuple[float, float, float]]]:
    """Gathered parameters {(repeat, fold): {feature: (median, mean, std)}}; features x repeats x folds rows."""
    out: dict[tuple[int, int], dict[str, tuple[float, float, float]]] = {}
    for r in stats.collect():
        out.setdefault((r["repeat"], r["fold"]), {})[r["feature"]] = (r["median"], r["mean"], r["std"])
    return out


def scale_by_fold(assigned: DataFrame, features: Sequence[str], stats: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, features): every row imputed and standardised with the parameters of its own (repeat, fold), by one join."""
    one = F.struct("feature", F.struct("median", "mean", "std"))
    # repeats x folds rows
    per_fold = stats.groupBy("repeat", "fold").agg(F.map_from_entries(F.collect_list(one)).alias("__of"))

    def ready(c: str) -> Column:
        p = F.element_at("__of", F.lit(c))
        return ((F.coalesce(F.col(c), p["median"]) - p["mean"]) / p["std"]).alias(c)

    return assigned.join(F.broadcast(per_fold), ["repeat", "fold"]).select(*keep, *map(ready, features))


def impute(features: Sequence[str], params: dict[str, tuple[float, float, float]]) -> list[Column]:
    absent = [c for c in features if c not in params]
    if absent:
        raise ValueError(f"training columns without any value: {absent}")
    return [F.coalesce(F.col(c), F.lit(params[c][0])).alias(c) for c in features]


def impute_scale(features: Sequence[str], params: dict[str, tuple[float, float, float]]) -> list[Column]:
    """Imputed and standardised columns from one fold's training parameters."""
    impute(features, params)
    return [
        ((F.coalesce(F.col(c), F.lit(params[c][0])) - F.lit(params[c][1])) / F.lit(params[c][2])).alias(c)
        for c in features
    ]


def fit_statistics(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Parameters of one training table: {feature: (median, mean, std)}."""
    base = train.select(F.lit(0).alias("repeat"), F.lit(1).alias("fold"), *features)
    marker = train.sparkSession.createDataFrame([(0, 0)], "repeat int, fold int")
    both = base.unionByName(marker, allowMissingColumns=True)
    return parameters(train_statistics(both, features)).get((0, 0), {})
