"""The full audit: population, duplicates, cross-validation, permutation test, persistent errors, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.rules import RuleSet
from probatum.operators import duplicates as D
from probatum.operators import metrics as M
from probatum.operators import models, parsing, permutation, preprocess, trees
from probatum.operators import splits as S
from probatum.sources import sinks

# Models that must all fail on a persistently wrong row, and the reported pairs.
CORE_MODELS = ("lr_all", "rf_all", "svm_all", "nested_single")
PAIRS = (("lr_all", "nested_single"), ("lr_all", "rf_all"), ("lr_all", "lr_no_psych"))
FLAG_FOLDS = 5


@dataclass(frozen=True)
class AuditSettings:
    tail_from: int | None  # primary scope: keys from here on are left out (None: keeps all)
    label_domain: Sequence[int] = (0, 1, 2)
    scope: str = "primary"  # or "sensitivity"
    policy: str = "raw"  # sensitivity only: raw, quarantine_out_of_range, grouped_duplicates
    k: int = 5
    repeats: int = 10
    inner_k: int = 3
    seed: int = 0
    n_perm: int = 100
    permutation_learner: str = "svm"  # or "tree": the best single-feature tree, from histograms alone
    smoke: bool = False
    run_validation: bool = True
    drop_columns: Sequence[str] = ()
    n_trees: int = 100
    max_depth: int = 30
    leak: Mapping[str, Sequence[float]] = field(default_factory=dict)
    posthoc: str | None = None  # SQL predicate on the included rows, reported beside the error flags

    def rows(self) -> parsing.Scope:
        if self.scope == "primary":
            return parsing.Scope(self.tail_from)
        return parsing.Scope(None, self.policy == "quarantine_out_of_range")


def describe_flags(
    df: DataFrame, key: str, flag: str, features: Sequence[str], seed: int, grouped: bool, depth: int = 3
) -> dict[str, Any]:
    """How well a shallow tree on all features predicts a 0/1 row flag, by 5-fold prediction."""
    counts = {r[flag]: r.n for r in df.groupBy(flag).agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict[str, Any] = {"n_flagged": counts.get(1, 0), "n_total": sum(counts.values()), "n_splits": FLAG_FOLDS}
    if grouped:
        return {**out, "status": "not_available", "reason": "no validated group-aware protocol"}
    try:
        S.check_feasible(df, flag, FLAG_FOLDS, name="flag_description.n_splits")
    except S.SplitError as e:
        return {**out, "status": "not_available", "reason": str(e)}
    folds = S.stratified_folds(df, key, flag, FLAG_FOLDS, 1, seed)
    rows = folds.join(df.drop(flag), key).persist()
    tree = models.Learner("tree", tuple(features), models.shallow_tree(depth, seed), scale=False)
    oof = models.predict_folds(rows, [tree], key, flag, [0, 1])
    m = M.class_metrics(M.confusion_counts(oof, ["model"]), ["model"], [0, 1]).collect()[0]
    zeros = counts.get(0, 0)
    base = 2 * zeros / (2 * zeros + counts.get(1, 0)) / 2
    return {
        **out, "status": "completed", "tree_macro_f1": m.macro_f1, "majority_baseline_macro_f1": base,
        "flagged_class_precision": m.class_1_precision, "flagged_class_recall": m.class_1_recall,
        "confusion_matrix": m.confusion_matrix,
    }


def full_pipeline(frame: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Logistic regression on all included rows as one saved pipeline: fill, scale, assemble, fit."""
    p = preprocess.fit_statistics(frame, features)
    cols = ", ".join(f"(coalesce(`{c}`, {p[c][0]!r}D) - {p[c][1]!r}D) / {p[c][2]!r}D AS `__{c}`" for c in features)
    n = frame.count()
    lr = LogisticRegression(
        featuresCol="vec", labelCol=label, family="multinomial", regParam=1.0 / (n * models.AUDIT_LR_C),
        elasticNetParam=0.0, standardization=False, maxIter=5000, tol=1e-6,
    )
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="vec"), lr,
    ]).fit(frame)


def preprocessing_of(model: PipelineModel) -> PipelineModel:
    """All stages but the classifier."""
    if len(model.stages) < 2:
        raise ValueError("pipeline needs at least one preprocessing stage and an estimator")
    return PipelineModel(stages=model.stages[:-1])


def run_full_audit(
    raw: DataFrame, key: str, label: str, rules: RuleSet, s: AuditSettings, out: str,
    features: Sequence[str] | None = None,
) -> dict[str, Any]:
    """Run the audit on a text table and write tables and one JSON document to a new folder.

    Everything that can fail on the data's shape fails before the folder is touched.
    """
    spark = raw.sparkSession
    prep = parsing.prepare(raw, key, label, s.label_domain, rules, s.rows(), features)
    feats, labels = prep.features, list(s.label_domain)
    prep.parsed.persist()  # every table below starts from it
    frame = prep.frame.persist()
    if frame.limit(1).count() == 0:
        raise S.SplitError("included sample is empty after exclusions")
    parsing.check_finite(frame, key, feats)
    run, group, notes = s.run_validation, None, {}
    if s.scope == "sensitivity":
        notes = {"policy": s.policy, **D.group_census(frame, feats).collect()[0].asDict(),
                 "n_out_of_range_cells": prep.above.count()}
        if s.policy == "grouped_duplicates":
            group = "duplicate_group_id"
        elif s.policy == "raw" and run and D.has_duplicates(frame, feats):
            notes["generalization"] = "refused: identical-feature duplicates present"
            run = False
    groups = D.feature_groups(frame, key, feats)
    data = frame.join(groups.select(key, "duplicate_group_id"), key).persist() if group else frame
    outer = inner = None
    perm_status, perm_reason = permutation.availability(run, group is not None)
    if run:
        outer, inner = S.plan_folds(data, key, label, labels, s.k, s.repeats, s.seed, s.inner_k, group)
        if perm_status == "completed":
            S.check_feasible(frame, label, permutation.PERMUTATION_FOLDS, name="permutation.n_splits")

    sinks.claim_output(spark, out)
    tables: dict[str, DataFrame] = {
        "exclusions": prep.excluded, "parse_issues": prep.issues, "field_checks": prep.checks,
        "out_of_range": prep.above, "domain_violations": prep.violations,
        "duplicate_group_ids": groups.join(frame.select(key, F.col(label).alias("true")), key),
    }
    dup = D.duplicate_audit(
        raw, prep.parsed, key, feats, label, labels, near=not s.smoke)
    tables |= {f"duplicate_audit_{n}": t for n, t in dup.items()}
    sinks.write_tables(tables, out)
    doc: dict[str, Any] = {
        "run_mode": "smoke" if s.smoke else "full",
        "settings": {k: str(v) for k, v in vars(s).items()},
        "domain_violations": sinks.records(parsing.violation_counts(prep.parsed, key, [*feats, label], rules))[0],
        "sample": sinks.records(frame.agg(
            F.count(F.lit(1)).alias("rows_used"), F.min(key).alias("first_id"), F.max(key).alias("last_id")))[0],
        "sensitivity": notes,
        "permutation": {"status": perm_status, "reason": perm_reason},
    }
    if run:
        doc |= _validate(data.select(key, label, *feats), key, label, labels, feats, s, outer, inner, group, out,
                         perm_status)
    model = full_pipeline(frame.select(key, label, *feats), feats, label)
    sinks.write_model(model, spark, f"{out}/model", feature_names=feats, label_classes=labels, scope=s.scope)
    sinks.write_json(spark, f"{out}/results", doc)
    sinks.write_status(spark, out, "completed")
    return doc


def _validate(
    data: DataFrame, key: str, label: str, labels: list[int], feats: list[str], s: AuditSettings, outer: DataFrame,
    inner: DataFrame | None, group: str | None, out: str, perm_status: str,
) -> dict[str, Any]:
    """The validation part of the audit: predictions, scores, permutation null, persistent errors, pairs."""
    learners = models.audit_learners(feats, s.drop_columns, s.seed, s.n_trees, s.max_depth)
    cv = models.run_cv(data, key, label, feats, labels, learners, outer, inner, store=f"{out}/oof_long")
    names = ["dummy", *[x.name for x in learners], "nested_single"]
    M.require_complete(cv.oof, data.select(key), key, names, s.repeats)
    fs, rs = M.fold_scores(cv.oof, labels).persist(), M.repeat_scores(cv.oof, labels).persist()
    pe = M.persistent_errors(cv.oof, key, CORE_MODELS)
    if s.posthoc:
        pe = pe.join(data.select(key, F.expr(s.posthoc).alias("posthoc")), key)
    pe = pe.persist()
    sinks.write_tables({
        "folds": S.membership(outer, s.k), "inner_folds": inner, "fold_scores": fs, "repeat_scores": rs,
        "inner_candidates": cv.candidates, "oof_predictions": M.wide_predictions(cv.oof, key, names),
        "per_sample_errors": pe,
    }, out)
    doc: dict[str, Any] = {
        "models": sinks.records(M.summarize_scores(fs, "fold", labels)),
        "models_repeat": sinks.records(M.summarize_scores(rs, "repeat", labels)),
        "picks": sinks.records(cv.picks.groupBy("feature").count()),
        "paired": sinks.records(M.paired_comparison(fs, S.fold_audit(outer, label, labels), PAIRS)),
    }
    if perm_status == "completed":
        scores = permutation.permutation_scores(
            data, key, label, feats, labels, s.leak, s.n_perm, s.seed, s.permutation_learner).persist()
        sinks.write_tables({"permutations": scores.filter(F.col("perm") >= 0)}, out)
        doc["permutation"] = {
            "status": perm_status,
            "observed": sinks.records(scores.filter(F.col("perm") == permutation.OBSERVED)),
            "null": sinks.records(permutation.null_summary(scores)),
        }
    flagged = pe.select(key, F.col("persistent_error_all_models").cast("int").alias("flag"))
    desc = describe_flags(data.select(key, *feats).join(flagged, key), key, "flag", feats, s.seed, group is not None)
    doc["persistent_errors"] = {"n_flagged": desc["n_flagged"], "feature_description_same_data": desc}
    if not s.smoke:
        rows = outer.select("repeat", "fold", key, label).join(data.drop(label), key)
        doc["single_feature_exploratory"] = sinks.records(trees.exploratory_scores(rows, feats, label, labels))
    return doc
