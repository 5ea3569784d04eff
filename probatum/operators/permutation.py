"""Label-permutation null: the same scoring on clean and on deliberately leaky features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.operators import models, trees
from probatum.operators.grouping import between_cuts, even_ranks, rank_cuts
from probatum.operators.invariance import permuted_labels, zero_leak
from probatum.operators.metrics import class_metrics, confusion_counts
from probatum.operators.splits import _hash

# Fixed value: folds of the permutation protocol.
PERMUTATION_FOLDS = 5
OBSERVED = -1


def availability(run: bool, grouped: bool) -> tuple[str, str | None]:
    """Whether the test applies: not when validation was refused, nor on grouped rows."""
    if not run:
        return "not_available", "validation skipped because the chosen scope refused it"
    if grouped:
        return "not_available", (
            "groups of identical features are no exchangeable units; a row-wise permutation under grouped "
            "folds is no valid grouped test"
        )
    return "completed", None


def permutation_rows(
    df: DataFrame, key: str, label: str, n_perm: int, seed: int, k: int = PERMUTATION_FOLDS, digits: int | None = None
) -> DataFrame:
    """(perm, fold, key, y): observed labels as perm -1 and ``n_perm`` shuffles, each with its stratified folds."""
    drawn = permuted_labels(df, key, label, n_perm, seed, digits)
    seen = df.select(F.lit(OBSERVED).alias("perm"), key, F.col(label).alias("y"))
    rows = drawn.unionByName(seen).withColumn("__h", _hash(F.lit(f"{seed}:cv"), F.col(key)))
    cuts = rank_cuts(rows, ["perm", "y"], "__h", even_ranks(k), digits)
    return between_cuts(rows, ["perm", "y"], "__h", cuts, "fold").select("perm", "fold", key, "y")


def tree_scores(rows: DataFrame, features: Sequence[str], labels: Sequence[int]) -> DataFrame:
    """(perm, macro_f1): per fold the single-feature tree with the best *training* macro-F1, averaged over folds.

    All permutations, folds and features come from one histogram aggregate.
    """
    keys = ["perm", "fold", "feature"]
    grown, valid = trees.single_feature_scores(rows, ["perm"], "fold", features, "y", labels)
    fit = class_metrics(trees.side_counts(grown, keys, labels, "t"), keys, labels)
    pick = trees.best_feature(fit, ["perm", "fold"], "macro_f1")
    return valid.join(pick, keys).groupBy("perm").agg(F.avg("macro_f1").alias("macro_f1"))


def svm_scores(rows: DataFrame, key: str, features: Sequence[str], labels: Sequence[int], threads: int = 4) -> DataFrame:
    """(perm, macro_f1) with the linear SVM."""
    learner = models.svm("svm", features, models.AUDIT_SVM_C)
    rows = rows.withColumnRenamed("perm", "repeat").persist()
    oof = models.predict_folds(rows, [learner], key, "y", labels, threads)
    m = class_metrics(confusion_counts(oof), ["repeat", "fold"], labels)
    return m.groupBy(F.col("repeat").alias("perm")).agg(F.avg("macro_f1").alias("macro_f1"))


def permutation_scores(
    df: DataFrame, key: str, label: str, features: Sequence[str], labels: Sequence[int],
    leak: Mapping[str, Sequence[float]], n_perm: int, seed: int = 0, learner: str = "tree", threads: int = 4,
) -> DataFrame:
    """(perm, clean, leaky, leaky_minus_clean); perm -1 is the observed labelling."""
    rows = permutation_rows(df, key, label, n_perm, seed).join(df.select(key, *features), key).persist()
    leaky = zero_leak(rows, "y", {c: v for c, v in leak.items() if c in features})

    def score(r: DataFrame) -> DataFrame:
        return tree_scores(r, features, labels) if learner == "tree" else svm_scores(r, key, features, labels, threads)

    c = score(rows).withColumnRenamed("macro_f1", "clean")
    lk = score(leaky).withColumnRenamed("macro_f1", "leaky")
    return c.join(lk, "perm").withColumn("leaky_minus_clean", F.col("leaky") - F.col("clean"))


def null_summary(scores: DataFrame) -> DataFrame:
    """(series, mean, sd, q05, q95, min, max, share_leaky_gt_clean) over the shuffles."""
    long = scores.filter(F.col("perm") != OBSERVED).withColumn(
        "win", (F.col("leaky_minus_clean") > 0).cast("double")
    ).unpivot(["perm", "win"], ["clean", "leaky", "leaky_minus_clean"], "series", "v")
    q = F.percentile("v", F.array(F.lit(0.05), F.lit(0.95)))
    return long.groupBy("series").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), q[0].alias("q05"), q[1].alias("q95"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("win").alias("share_leaky_gt_clean"),
    )
