"""Classifiers fitted on training folds only, and their cross-validation.

Every model is fitted by Spark ML, fold by fold, from a few threads.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators import preprocess, trees
from probatum.operators.metrics import class_metrics, confusion_counts, fold_scores, paired_comparison
from probatum.operators.splits import fold_audit, inner_folds, stratified_folds
from probatum.session import cut_lineage

PAIR_THREADS = 3  # pairs of labels fitted at a time
TASK_ROWS = 200_000  # rows of a linear fit in one task

Predict = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Learner:
    """A named classifier over some columns.

    ``fit(train, label, labels)`` gets (key, vec, label) rows with the prepared vector ``vec`` and returns
    a function adding a ``pred`` column. ``scale`` asks for standardised columns, ``fill`` names the
    imputation statistic.
    """

    name: str
    features: tuple[str, ...]
    fit: Callable[[DataFrame, str, Sequence[int]], Predict]
    scale: bool = True
    fill: str = "median"


def lr(name: str, features: Sequence[str], c: float = 1.0) -> Learner:
    return Learner(name, tuple(features), logistic(c))


def svm(name: str, features: Sequence[str], c: float = 0.2) -> Learner:
    return Learner(name, tuple(features), linear_svm(c))


def logistic(c: float = 1.0, max_iter: int = 5000) -> Callable[[DataFrame, str, Sequence[int]], Predict]:
    """Multinomial L2 logistic regression; ``c`` is the inverse penalty of the summed loss."""

    def fit(train: DataFrame, label: str, labels: Sequence[int]) -> Predict:
        n = train.count()
        rows = in_few_tasks(train, n)
        model = LogisticRegression(
            featuresCol="vec", labelCol=label, family="multinomial", regParam=1.0 / (n * c), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=1e-6, predictionCol="pred", rawPredictionCol="__raw",
            probabilityCol="__prob",
        ).fit(rows)
        require_converged(model.summary.totalIterations, max_iter)
        return lambda df: model.transform(df).drop("__raw", "__prob")

    return fit


def in_few_tasks(train: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in a task per ``TASK_ROWS``: an optimiser runs a job a step, which tasks of few rows would only prolong."""
    return train.coalesce(max(1, math.ceil(n / TASK_ROWS)))


def require_converged(iterations: int, most: int) -> None:
    """An optimiser that used up its steps has not reached the optimum."""
    if iterations >= most:
        raise RuntimeError(f"linear model did not converge in {most} iterations")


def linear_svm(c: float = 0.2, max_iter: int = 40) -> Callable[[DataFrame, str, Sequence[int]], Predict]:
    """One-vs-one linear hinge classifiers with majority vote, the lowest label on ties.

    The hinge has a kink, near which the optimiser rarely meets a tolerance; ``max_iter`` says how far it goes, and a fit that
    uses it up warns.
    """

    def fit(train: DataFrame, label: str, labels: Sequence[int]) -> Predict:
        sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # one row per label

        def fit_pair(sides: tuple[int, int]) -> tuple:
            a, b = sides
            pair = train.filter(F.col(label).isin(a, b)).withColumn("__side", (F.col(label) == b).cast("double"))
            model = LinearSVC(
                featuresCol="vec", labelCol="__side", regParam=1.0 / ((sizes[a] + sizes[b]) * c),
                standardization=False, maxIter=max_iter, tol=1e-4, predictionCol=f"__p_{a}_{b}",
                rawPredictionCol=f"__r_{a}_{b}",
            ).fit(in_few_tasks(pair, sizes[a] + sizes[b]))
            if model.summary().totalIterations >= max_iter:
                warnings.warn(f"linear SVM of {a} against {b} stopped after {max_iter} iterations", RuntimeWarning, stacklevel=2)
            return a, b, model

        with ThreadPoolExecutor(PAIR_THREADS) as pool:
            votes = list(pool.map(fit_pair, combinations([v for v in labels if v in sizes], 2)))

        def predict(df: DataFrame) -> DataFrame:
            for a, b, m in votes:
                df = m.transform(df).drop(f"__r_{a}_{b}")

            def tally(v: int) -> Column:
                won = [F.when(F.col(f"__p_{a}_{b}") == (1.0 if v == b else 0.0), 1).otherwise(0)
                       for a, b, _ in votes if v in (a, b)]
                return reduce(lambda x, y: x + y, won, F.lit(0))

            best = F.greatest(*[F.struct(tally(v).alias("n"), F.lit(-v).alias("neg")) for v in sizes]) if len(
                sizes) > 1 else F.struct(F.lit(0).alias("n"), F.lit(-next(iter(sizes))).alias("neg"))
            return df.withColumn("pred", -best["neg"]).drop(*[f"__p_{a}_{b}" for a, b, _ in votes])

        return predict

    return fit


def _tree_fit(make: Callable[[], object]) -> Callable[[DataFrame, str, Sequence[int]], Predict]:
    def fit(train: DataFrame, label: str, labels: Sequence[int]) -> Predict:
        est = make()
        est.setFeaturesCol("vec").setLabelCol(label).setPredictionCol("pred")
        model = est.fit(train)
        extra = {"rawPrediction", "probability"}
        return lambda df: model.transform(df).drop(*extra)

    return fit


def random_forest(n_trees: int = 100, max_depth: int = 30, min_leaf: int = 1, seed: int = 0, max_bins: int = 64):
    """Random forest; depth 30 is the engine's limit and stands for unrestricted trees. Splits are looked for between
    ``max_bins`` bins of a column's values."""
    return _tree_fit(lambda: RandomForestClassifier(
        numTrees=n_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed,
        maxBins=max_bins,
    ))


def shallow_tree(depth: int = 3, seed: int = 0, max_bins: int = 256):
    return _tree_fit(lambda: DecisionTreeClassifier(maxDepth=depth, seed=seed, maxBins=max_bins))


def boosted_trees(n_rounds: int = 100, depth: int = 4, rate: float = 0.1, seed: int = 0):
    """Boosted trees, one against the rest (the engine's boosting is binary)."""
    return _tree_fit(lambda: OneVsRest(classifier=GBTClassifier(
        maxIter=n_rounds, maxDepth=depth, stepSize=rate, seed=seed)))


# Regularisation of the audited models.
AUDIT_LR_C = 1.0
AUDIT_SVM_C = 0.2


def audit_learners(
    features: Sequence[str], drop: Sequence[str] = (), seed: int = 0, n_trees: int = 100, max_depth: int = 30
) -> list[Learner]:
    """The audited classifiers; the most-frequent and nested single-feature models are built in ``run_cv``."""
    feats = tuple(features)
    fewer = tuple(c for c in feats if c not in set(drop))
    return [
        lr("lr_all", feats, AUDIT_LR_C),
        Learner("rf_all", feats, random_forest(n_trees, max_depth, seed=seed), scale=False),
        svm("svm_all", feats, AUDIT_SVM_C),
        lr("lr_no_psych", fewer, AUDIT_LR_C),
    ]


def most_frequent(folds: DataFrame, key: str, label: str) -> DataFrame:
    """Predictions of the majority training label (lowest on ties) for all folds in one aggregate."""
    n = folds.groupBy("repeat", "fold", label).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("repeat", label).agg(F.sum("n").alias("all"))
    keys = n.select("repeat", "fold").distinct()
    own = n.select("repeat", "fold", label, F.col("n").alias("own"))
    train = total.join(keys, "repeat").join(own, ["repeat", "fold", label], "left")
    left = F.col("all") - F.coalesce("own", F.lit(0))
    # repeats x folds rows
    modes = train.groupBy("repeat", "fold").agg(F.max_by(label, F.struct(left, -F.col(label))).alias("pred"))
    return folds.join(F.broadcast(modes), ["repeat", "fold"]).select(
        F.lit("dummy").alias("model"), "repeat", "fold", key, F.col(label).alias("y"), "pred"
    )


def vectors(
    rows: DataFrame, learner: Learner, params: dict[str, tuple[float, float, float]], keep: Sequence[str]
) -> DataFrame:
    """(keep, vec) with the learner's columns filled (and scaled) by training parameters only."""
    make = preprocess.impute_scale if learner.scale else preprocess.impute
    ready = rows.select(*keep, *make(learner.features, params))
    return VectorAssembler(inputCols=list(learner.features), outputCol="vec").transform(ready).select(*keep, "vec")


def fit_fold(
    rows: DataFrame, learner: Learner, params: dict[str, tuple[float, float, float]], key: str, label: str,
    labels: Sequence[int], repeat: int, fold: int,
) -> DataFrame:
    """Fit on every other fold of one repeat's rows and predict this one."""
    vec = vectors(rows, learner, params, [key, label, "fold"])
    train = vec.filter(F.col("fold") != fold).persist()
    predict = learner.fit(train, label, labels)
    train.unpersist()
    out = predict(vec.filter(F.col("fold") == fold).drop("fold"))
    return out.select(
        F.lit(learner.name).alias("model"), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), key,
        F.col(label).alias("y"), F.col("pred").cast("int").alias("pred"),
    )


def learner_statistics(rows: DataFrame, learners: Sequence[Learner]) -> dict[str, dict]:
    """Training parameters per imputation statistic, each for all folds in one pass."""
    out: dict[str, dict] = {}
    for fill in {x.fill for x in learners}:
        feats = sorted({f for x in learners if x.fill == fill for f in x.features})
        if fill == "median":
            out[fill] = preprocess.parameters(preprocess.train_statistics(rows, feats))
        else:
            table = preprocess.train_modes(rows, feats).withColumnsRenamed({"mode": "median"}).withColumns(
                {"mean": F.lit(0.0), "std": F.lit(1.0)})
            out[fill] = preprocess.parameters(table)
    return out


def predict_folds(
    rows: DataFrame, learners: Sequence[Learner], key: str, label: str, labels: Sequence[int], threads: int = 4
) -> DataFrame:
    """Out-of-fold predictions of every learner on every (repeat, fold) of ``rows``.

    ``rows`` is (repeat, fold, key, label, features). Fits are submitted from a few threads so that
    short jobs of one fit fill the gaps of another.
    """
    params = learner_statistics(rows, learners)
    spots = sorted(params[learners[0].fill])
    done = []
    for rep in sorted({r for r, _ in spots}):
        part = rows.filter(F.col("repeat") == rep).persist()  # read by every fit of the repeat, and by its predictions

        def run(task: tuple[Learner, int], rep: int = rep, part: DataFrame = part) -> DataFrame:
            x, fold = task
            return fit_fold(part, x, params[x.fill][(rep, fold)], key, label, labels, rep, fold)

        with ThreadPoolExecutor(threads) as pool:
            parts = list(pool.map(run, [(x, fold) for r, fold in spots if r == rep for x in learners]))
        done.append(cut_lineage(reduce(DataFrame.unionByName, parts)))
        part.unpersist()
    return reduce(DataFrame.unionByName, done)


@dataclass
class CvResult:
    oof: DataFrame
    folds: DataFrame
    inner: DataFrame | None
    candidates: DataFrame | None = None
    picks: DataFrame | None = None
    learners: Sequence[Learner] = field(default_factory=list)


def run_cv(
    df: DataFrame, key: str, label: str, features: Sequence[str], labels: Sequence[int], learners: Sequence[Learner],
    folds: DataFrame, inner: DataFrame | None, store: str | None = None, threads: int = 4,
) -> CvResult:
    """All models on shared folds: most-frequent, the given learners and, with inner folds, nested single.

    With ``store`` the predictions are written there by (model, repeat) and read back, which is what
    large runs should do: they are rows x repeats x models long.
    """
    rows = folds.select("repeat", "fold", key, label).join(df.drop(label), key).persist()
    parts = [most_frequent(folds, key, label)]
    if learners:
        parts.append(predict_folds(rows, learners, key, label, labels, threads))
    cand = picks = None
    if inner is not None:
        outer_rows = folds.select("repeat", "fold", key, label).join(df.drop(label), key)
        inner_rows = inner.select("repeat", "fold", "inner_fold", key, label).join(df.drop(label), key)
        single, cand, picks = trees.nested_single(outer_rows, inner_rows, key, features, label, labels)
        parts.append(single)
    oof = reduce(DataFrame.unionByName, parts)
    if store is not None:
        oof.write.mode("errorifexists").partitionBy("model", "repeat").parquet(store)
        oof = df.sparkSession.read.parquet(store)
    return CvResult(oof, folds, inner, cand, picks, learners)


def variant_scores(
    df: DataFrame, key: str, label: str, labels: Sequence[int], variants: dict[str, Sequence[str]], k: int = 5,
    repeats: int = 10, seed: int = 0, threads: int = 4,
) -> DataFrame:
    """Pooled macro-F1 of logistic regression on column subsets: (model, n_features, mean, std)."""
    folds = stratified_folds(df, key, label, k, repeats, seed).persist()
    rows = folds.join(df.drop(label), key).persist()
    learners = [lr(n, cols, AUDIT_LR_C) for n, cols in variants.items()]
    oof = predict_folds(rows, learners, key, label, labels, threads)
    scores = class_metrics(confusion_counts(oof), ["model", "repeat"], labels)
    sizes = df.sparkSession.createDataFrame(
        [(n, len(c)) for n, c in variants.items()], "model string, n_features int")
    return scores.groupBy("model").agg(
        F.avg("macro_f1").alias("mean"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("std")
    ).join(F.broadcast(sizes), "model")


# Candidate order of the nested search; the position breaks ties.
SEARCH_LR_C = (0.1, 1.0, 10.0)
SEARCH_SVM_C = (0.05, 0.2, 0.8)
SEARCH_RF_TREES = (100, 300)
SEARCH_RF_DEPTH = (8, None)
SEARCH_RF_LEAF = (4, 1)
SEARCH_COMPARISONS = (("b_lr", "dummy"), ("b_lr", "nested_single"), ("b_lr", "lr_all"), ("b_select", "lr_all"))


def search_candidates(features: Sequence[str], seed: int = 0) -> list[tuple[str, Learner]]:
    """(family, learner) in priority order: logistic, linear SVM, forests."""
    f = tuple(features)
    out = [("lr", lr(f"lr_c{c}", f, c)) for c in SEARCH_LR_C]
    out += [("svm", svm(f"svm_c{c}", f, c)) for c in SEARCH_SVM_C]
    out += [
        ("rf", Learner(f"rf_t{t}_d{d}_l{leaf}", f, random_forest(t, d or 30, leaf, seed), scale=False))
        for t in SEARCH_RF_TREES for d in SEARCH_RF_DEPTH for leaf in SEARCH_RF_LEAF
    ]
    return out


def inner_scores(
    df: DataFrame, inner: DataFrame, candidates: Sequence[tuple[str, Learner]], key: str, label: str,
    labels: Sequence[int], threads: int = 4,
) -> DataFrame:
    """(repeat, fold, priority, family, candidate, inner_macro_f1) of every candidate on the inner folds."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(i, fam, x.name) for i, (fam, x) in enumerate(candidates)], "priority int, family string, candidate string")
    outer = [(r["repeat"], r["fold"]) for r in inner.select("repeat", "fold").distinct().collect()]
    rows = inner.join(df.drop(label), key).persist()
    parts = []
    for rep, fold in sorted(outer):
        part = rows.filter((F.col("repeat") == rep) & (F.col("fold") == fold)).drop("fold", "repeat").withColumn(
            "repeat", F.lit(0)).withColumnRenamed("inner_fold", "fold")
        oof = predict_folds(part, [x for _, x in candidates], key, label, labels, threads)
        parts.append(class_metrics(confusion_counts(oof), ["model", "fold"], labels).groupBy(
            F.lit(rep).alias("repeat"), F.lit(fold).alias("fold"), F.col("model").alias("candidate")
        ).agg(F.avg("macro_f1").alias("inner_macro_f1")))
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(table), "candidate")


def pick_candidates(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners per (repeat, fold, family) and per (repeat, fold): best score, then list position."""
    family = trees.best_priority(scores, ["repeat", "fold", "family"], "inner_macro_f1", "priority")
    return family, trees.best_priority(family, ["repeat", "fold"], "inner_macro_f1", "priority")


def nested_search(
    df: DataFrame, folds: DataFrame, inner: DataFrame, candidates: Sequence[tuple[str, Learner]], key: str, label: str,
    labels: Sequence[int], threads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(predictions of b_lr and b_select, inner scores).

    Each family's winner is refitted once per outer fold; the overall winner is one of them, so it reuses
    that refit.
    """
    scores = inner_scores(df, inner, candidates, key, label, labels, threads).persist()
    family, overall = pick_candidates(scores)
    by_name = {x.name: x for _, x in candidates}
    rows = folds.join(df.drop(label), key).persist()
    params = learner_statistics(rows, [x for _, x in candidates])
    best = {(r["repeat"], r["fold"]): r.family for r in overall.collect()}  # one row per outer fold
    parts = []
    for r in family.collect():  # families x outer folds rows
        spot = (r["repeat"], r["fold"])
        names = (["b_lr"] if r.family == "lr" else []) + (["b_select"] if best[spot] == r.family else [])
        if not names:
            continue
        x = by_name[r.candidate]
        part = rows.filter(F.col("repeat") == spot[0])
        out = fit_fold(part, x, params[x.fill][spot], key, label, labels, *spot)
        parts += [out.withColumn("model", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts), scores


def search_comparisons(
    df: DataFrame, folds: DataFrame, searched: DataFrame, single: DataFrame, key: str, label: str, labels: Sequence[int],
    features: Sequence[str], pairs: Sequence[tuple[str, str]] = SEARCH_COMPARISONS, threads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(paired intervals, fold scores) of the declared comparisons of a nested search.

    ``searched`` holds the predictions of b_lr and b_select, ``single`` those of the nested single-feature tree; the dummy and
    the plain logistic regression on all features are fitted here on the same outer folds.
    """
    plain = predict_folds(folds.join(df.drop(label), key), [lr("lr_all", features)], key, label, labels, threads)
    dummy = most_frequent(folds, key, label)
    names = ["model", "repeat", "fold", key, "y", "pred"]
    oof = cut_lineage(reduce(DataFrame.unionByName, [x.select(*names) for x in (searched, single, plain, dummy)]))
    scores = fold_scores(oof, labels).persist()
    return paired_comparison(scores, fold_audit(folds, label, labels), pairs), scores


def grid_search(
    df: DataFrame, key: str, label: str, labels: Sequence[int], features: Sequence[str],
    cs: Sequence[float] = (0.1, 1.0, 10.0), k: int = 3, seed: int = 0, threads: int = 4,
) -> DataFrame:
    """(candidate, priority, macro_f1) of logistic regression over C by k-fold mean macro-F1, best first."""
    folds = inner_folds_of_one(df, key, label, k, seed)
    cands = [("lr", lr(f"lr_c{c}", features, c)) for c in cs]
    s = inner_scores(df, folds, cands, key, label, labels, threads)
    return s.select("candidate", "priority", F.col("inner_macro_f1").alias("macro_f1")).orderBy(
        F.desc("macro_f1"), "priority")


def inner_folds_of_one(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """One k-fold plan in the shape of inner folds of a single outer training part."""
    f = stratified_folds(df, key, label, k, 1, seed)
    return f.select("repeat", F.lit(0).alias("fold"), F.col("fold").alias("inner_fold"), key, label)


def two_level(df: DataFrame, key: str, label: str, k: int, repeats: int, inner_k: int, seed: int = 0):
    """Cached outer and inner stratified folds without the feasibility checks of ``plan_folds``."""
    outer = stratified_folds(df, key, label, k, repeats, seed).persist()
    return outer, inner_folds(outer, key, label, k, inner_k, seed).persist()


def predict_without_label(predict: Predict, df: DataFrame, label: str) -> DataFrame:
    """Predict from a table that no longer carries the label."""
    return predict(df.drop(label))
