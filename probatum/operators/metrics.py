"""Classification metrics over a long prediction relation (model, repeat, fold, key, y, pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.stats import t_quantile

FOLD_KEYS = ("model", "repeat", "fold")
REPEAT_KEYS = ("model", "repeat")


def confusion_counts(oof: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """(keys, y, pred, n): the only pass over predictions; every metric below starts from this small table."""
    return oof.groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(num: Column, den: Column) -> Column:
    """Quotient with zero for an empty denominator."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def class_metrics(counts: DataFrame, keys: Sequence[str], labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row per ``keys`` group from (y, pred, n) counts.

    Precision, recall, F1 (zero when undefined) and support per label; macro-F1 over all given labels even
    if absent; accuracy; the confusion matrix; and errors between the two extreme labels with their rate
    among rows of an extreme label (NULL without such rows).
    """
    y, p, n = F.col("y"), F.col("pred"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")

    cells = [total((y == a) & (p == b)).alias(f"m_{a}_{b}") for a in labels for b in labels]
    truth = [total(y == a).alias(f"class_{a}_support") for a in labels]
    said = [total(p == a).alias(f"said_{a}") for a in labels]
    g = counts.groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("n_samples"), total(y == p).alias("n_right"), *cells, *truth, *said
    )
    lo, hi = labels[0], labels[-1]
    out = g
    for a in labels:
        hit, sup, sd = F.col(f"m_{a}_{a}"), F.col(f"class_{a}_support"), F.col(f"said_{a}")
        out = out.withColumns({
            f"class_{a}_precision": _ratio(hit, sd),
            f"class_{a}_recall": _ratio(hit, sup),
            f"class_{a}_f1": _ratio(2 * hit, sup + sd),
        })
    f1s = sum((F.col(f"class_{a}_f1") for a in labels), F.lit(0.0))
    matrix = F.array(*[F.array(*[F.col(f"m_{a}_{b}") for b in labels]) for a in labels])
    cross, ends = F.col(f"m_{lo}_{hi}") + F.col(f"m_{hi}_{lo}"), F.col(f"class_{lo}_support") + F.col(
        f"class_{hi}_support"
    )
    return out.select(
        *keys,
        "n_samples",
        (f1s / len(labels)).alias("macro_f1"),
        (F.col("n_right") / F.col("n_samples")).alias("accuracy"),
        cross.alias("extreme_error_numerator"),
        ends.alias("extreme_error_denominator"),
        F.try_divide(cross, ends).alias("extreme_error_rate"),
        matrix.alias("confusion_matrix"),
        *[F.col(f"class_{a}_{m}") for a in labels for m in ("precision", "recall", "f1", "support")],
    )


def fold_scores(oof: DataFrame, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    return class_metrics(confusion_counts(oof), FOLD_KEYS, labels)


def repeat_scores(oof: DataFrame, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Metrics of the pooled predictions of each repeat."""
    return class_metrics(confusion_counts(oof), REPEAT_KEYS, labels)


def summary_columns(labels: Sequence[int]) -> list[str]:
    return ["macro_f1", "accuracy", "extreme_error_rate"] + [
        f"class_{a}_{m}" for a in labels for m in ("precision", "recall", "f1")
    ]


def summarize_scores(
    scores: DataFrame, unit: str, labels: Sequence[int] = (0, 1, 2), by: Sequence[str] = ("model",)
) -> DataFrame:
    """Mean and sample deviation per model over folds (``unit="fold"``) or repeats (``unit="repeat"``).

    The deviation of a single unit is 0 for folds and NULL for repeats. The matrix is the element-wise sum.
    """
    if unit not in ("fold", "repeat"):
        raise ValueError("unit is 'fold' or 'repeat'")
    aggs: list[Column] = [F.count(F.lit(1)).alias(f"n_{unit}s")]
    for m in summary_columns(labels):
        sd = F.stddev_samp(m)
        if unit == "fold":
            sd = F.coalesce(sd, F.lit(0.0))
        aggs += [F.avg(m).alias(f"{m}_mean"), sd.alias(f"{m}_std")]
    order = ["repeat", "fold"] if unit == "fold" else ["repeat"]
    k = len(labels)
    aggs += [F.sum(F.col("confusion_matrix")[i][j]).alias(f"__{i}_{j}") for i in range(k) for j in range(k)]
    # folds or repeats of one model: a number the caller chose, not one that grows with the rows
    listed = F.sort_array(F.collect_list(F.struct(*order, "confusion_matrix")))
    aggs.append(F.transform(listed, lambda s: s["confusion_matrix"]).alias(f"confusion_matrix_per_{unit}"))
    out = scores.groupBy(*by).agg(*aggs)
    summed = F.array(*[F.array(*[F.col(f"__{i}_{j}") for j in range(k)]) for i in range(k)])
    return out.withColumn("confusion_matrix_sum", summed).drop(*[f"__{i}_{j}" for i in range(k) for j in range(k)])


def classification_report(counts: DataFrame, labels: Sequence[int], keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, class, precision, recall, f1, support) with macro and support-weighted averages."""
    m = class_metrics(counts, keys, labels)
    cols = ("precision", "recall", "f1", "support")
    per = m.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(str(a)).alias("class"), *[F.col(f"class_{a}_{c}").alias(c) for c in cols]) for a in labels
    ])))
    sup = F.sum("support").cast("bigint")
    macro = per.groupBy(*keys).agg(
        F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in cols[:3]], sup.alias("support")
    )
    weighted = per.groupBy(*keys).agg(
        F.lit("weighted avg").alias("class"),
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols[:3]],
        sup.alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted)


def paired_comparison(scores: DataFrame, audit: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Corrected paired interval of macro-F1 differences per (a, b) pair over shared folds.

    ``audit`` gives n_valid and n_train per (repeat, fold). The variance is inflated by the mean
    valid/train ratio because training parts overlap. Raises when the models do not share their folds.
    """
    spark = scores.sparkSession
    wanted = spark.createDataFrame(list(pairs), "model_a string, model_b string")  # caller's list
    s = scores.select("model", "repeat", "fold", "macro_f1")
    a = F.broadcast(wanted).join(s.withColumnsRenamed({"model": "model_a", "macro_f1": "fa"}), "model_a")
    b = s.withColumnsRenamed({"model": "model_b", "macro_f1": "fb"})
    sizes = audit.select("repeat", "fold", "n_valid", "n_train")
    d = a.join(b, ["model_b", "repeat", "fold"]).join(sizes, ["repeat", "fold"])
    diff = F.col("fa") - F.col("fb")
    rows = d.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("j"), F.avg(diff).alias("mean_diff"), F.var_samp(diff).alias("var"),
        F.avg("n_valid").alias("te"), F.avg("n_train").alias("tr"),
        F.avg((diff > 0).cast("double")).alias("share_of_folds_a_higher"),
    ).collect()  # one row per requested pair
    have = {r.model: r.n for r in s.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = {(r.model_a, r.model_b): r.j for r in rows}
    for m, o in pairs:
        if not have.get(m) or shared.get((m, o), 0) != have[m] or have.get(o) != have[m]:
            raise ValueError(f"{m} and {o} were not scored on the same folds")
    out = []
    for r in rows:
        se = ((1 / r.j + r.te / r.tr) * (r["var"] or 0.0)) ** 0.5
        if r.j < 2:  # one shared fold: no spread, no interval
            out.append((r.model_a, r.model_b, r.mean_diff, None, r.j - 1, None, None, None, r.share_of_folds_a_higher))
            continue
        t = t_quantile(0.975, r.j - 1)
        out.append((r.model_a, r.model_b, r.mean_diff, se, r.j - 1, t, r.mean_diff - t * se, r.mean_diff + t * se,
                    r.share_of_folds_a_higher))
    return spark.createDataFrame(
        out,
        "model_a string, model_b string, mean_diff double, corrected_se double, df int, t_crit double, "
        "ci_low double, ci_high double, share_of_folds_a_higher double",
    )


def fold_differences(scores: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(model_a, model_b, repeat, fold, diff, direction): macro-F1 of a less that of b on every shared fold."""
    wanted = scores.sparkSession.createDataFrame(list(pairs), "model_a string, model_b string")  # caller's list
    s = scores.select("model", "repeat", "fold", "macro_f1")
    a = F.broadcast(wanted).join(s.withColumnsRenamed({"model": "model_a", "macro_f1": "fa"}), "model_a")
    b = s.withColumnsRenamed({"model": "model_b", "macro_f1": "fb"})
    diff = F.col("fa") - F.col("fb")
    way = F.when(diff > 0, "a_higher").when(diff < 0, "b_higher").otherwise("equal")
    return a.join(b, ["model_b", "repeat", "fold"]).select("model_a", "model_b", "repeat", "fold", diff.alias("diff"), way.alias("direction"))


def require_complete(oof: DataFrame, ids: DataFrame, key: str, models: Sequence[str], repeats: int) -> None:
    """Raise unless every row has exactly one prediction per model and repeat.

    Counts per (model, repeat) are compared first; a wrong total or a NULL prediction fails at once, and
    equal totals with a repeated key are caught by the per-key count.
    """
    n = ids.count()
    got = {(r.model, r["repeat"]): r.n for r in oof.filter("pred is not null").groupBy("model", "repeat").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # models x repeats rows
    for m in models:
        for rep in range(repeats):
            if got.get((m, rep), 0) != n:
                raise ValueError(f"{m}, repeat {rep}: {n - got.get((m, rep), 0)} of {n} rows lack a prediction")
    twice = oof.groupBy("model", "repeat", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one OOF prediction: {twice[0].asDict()}")


def wide_predictions(oof: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """One row per (repeat, key, y) with a column per model."""
    return oof.groupBy("repeat", key, "y").agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models]
    )


# Fixed value: error rate from which a row counts as persistently wrong.
PERSISTENT_ERROR_RATE = 0.8


def persistent_errors(
    oof: DataFrame, key: str, models: Sequence[str], threshold: float = PERSISTENT_ERROR_RATE
) -> DataFrame:
    """Per row: error rate over repeats in each model, flagged when all rates reach the threshold."""
    rates = [
        F.avg(F.when(F.col("model") == m, (F.col("pred") != F.col("y")).cast("double"))).alias(m) for m in models
    ]
    out = oof.groupBy(key).agg(
        F.max("y").alias("true"), *rates, F.count_if(F.col("model") == models[0]).alias("n_valid_repeats")
    )
    worst = F.least(*models) if len(models) > 1 else F.col(models[0])
    return out.withColumn("persistent_error_all_models", worst >= threshold)
