from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from probatum.functions.rules import FieldRule, RuleSet
from probatum.operators import metrics as M
from probatum.operators import models as L
from probatum.operators import splits as S
from probatum.plans import audit, proxy
from probatum.sources import sinks

LABELS = [0, 1, 2]


def table(spark, n=180):
    """A label that follows f1 closely, f2 loosely and f3 not at all, with missing cells."""
    return spark.range(n).selectExpr(
        "id", "cast(id % 3 as int) y",
        "case when id % 17 = 0 then null else id % 3 * 2.0 + pmod(hash(id), 100) / 60.0 end f1",
        "id % 3 + pmod(hash(id, 1), 100) / 40.0 f2", "pmod(hash(id, 2), 100) / 10.0 f3")


def test_models_on_shared_folds(spark):
    df = table(spark).persist()
    outer, inner = S.plan_folds(df, "id", "y", LABELS, 3, 1, 0, 2, digits=1)
    f = ("f1", "f2", "f3")
    learners = [L.lr("lr_all", f), L.svm("svm_all", f),
                L.Learner("rf_all", f, L.random_forest(5, 5), scale=False),
                L.Learner("tree", f, L.shallow_tree(), scale=False, fill="mode")]
    cv = L.run_cv(df, "id", "y", f, LABELS, learners, outer, inner)
    o = cv.oof.persist()
    M.require_complete(o, df.select("id"), "id", ["dummy", "lr_all", "svm_all", "rf_all", "tree", "nested_single"], 1)
    score = {r.model: r.macro_f1 for r in M.repeat_scores(o).collect()}
    assert score["dummy"] == pytest.approx(1 / 6, abs=0.02)
    assert all(score[m] > 0.7 for m in score if m != "dummy"), score


def test_search_order_and_selection(spark):
    names = [x.name for _, x in L.search_candidates(["a"])]
    assert len(names) == 14 and names[:3] == ["lr_c0.1", "lr_c1.0", "lr_c10.0"]
    assert names[6:8] == ["rf_t100_d8_l4", "rf_t100_d8_l1"]
    s = spark.createDataFrame(
        [(0, 0, 0, "lr", "a", .8), (0, 0, 1, "lr", "b", .8), (0, 0, 2, "rf", "c", .8), (0, 1, 0, "lr", "a", .7),
         (0, 1, 2, "rf", "c", .9)],
        "repeat int, fold int, priority int, family string, candidate string, inner_macro_f1 double")
    family, overall = L.pick_candidates(s)
    assert {(r.fold, r.family): r.candidate for r in family.collect()} == {
        (0, "lr"): "a", (0, "rf"): "c", (1, "lr"): "a", (1, "rf"): "c"}
    assert {r.fold: r.candidate for r in overall.collect()} == {0: "a", 1: "c"}


def raw(spark, n=120):
    return table(spark, n).selectExpr("id", "cast(f1 as string) f1", "cast(f2 as string) f2", "cast(f3 as string) f3",
                                      "case when id = 5 then 'Null' else cast(y as string) end y")


RULES = RuleSet({"y": FieldRule("y", 0.0, 2.0, True, (0.0, 1.0, 2.0))}, {"f3": 20.0})


def test_full_audit(spark, tmp_path):
    out = str(tmp_path / "run")
    s = audit.AuditSettings(tail_from=110, k=2, repeats=1, inner_k=2, n_perm=2, permutation_learner="tree", n_trees=3,
                            max_depth=4, drop_columns=("f2",), leak={"f1": (1, 2, 3)}, posthoc="f1 > 4 and y < 2", smoke=True)
    doc = audit.run_full_audit(raw(spark), "id", "y", RULES, s, out)
    assert doc["sample"]["rows_used"] == 109
    assert {r["model"] for r in doc["models"]} == {"dummy", "lr_all", "rf_all", "svm_all", "lr_no_psych", "nested_single"}
    assert len(doc["paired"]) == 3 and doc["permutation"]["status"] == "completed"
    assert sinks.read_status(spark, out) == "completed"
    assert spark.read.option("header", True).csv(f"{out}/exclusions").count() == 11
    model = PipelineModel.load(f"{out}/model/pipeline")
    shown = audit.preprocessing_of(model).transform(table(spark).drop("y"))
    assert "vec" in shown.columns
    pred = L.predict_without_label(model.transform, table(spark), "y")
    assert pred.filter("prediction = id % 3").count() > 140


def test_refused_scope_writes_no_validation(spark, tmp_path):
    dup = raw(spark, 60).unionByName(raw(spark, 60).selectExpr("id + 1000 id", "f1", "f2", "f3", "y"))
    s = audit.AuditSettings(None, scope="sensitivity", policy="raw", k=2, repeats=1, smoke=True)
    doc = audit.run_full_audit(dup, "id", "y", RULES, s, str(tmp_path / "run"))
    assert doc["sensitivity"]["generalization"].startswith("refused") and "models" not in doc
    assert doc["permutation"]["status"] == "not_available"


def test_failed_plan_leaves_no_folder(spark, tmp_path):
    out = tmp_path / "run"
    with pytest.raises(S.SplitError):
        audit.run_full_audit(raw(spark, 12), "id", "y", RULES, audit.AuditSettings(None, k=9), str(out))
    assert not out.exists()


def test_proxy_report(spark, tmp_path):
    df = table(spark, 90).selectExpr("id", "y", "f1", "f2", "cast(id % 3 as double) p")
    report, tables = proxy.label_proxy_report(df, "id", "y", LABELS, ["f1", "f2", "p"], "p", ["f1", "p"], 2, 1)
    assert {r["n_features"] for r in report["lr_variants"].values()} == {3, 1, 2}
    assert report["lr_variants"]["lr_p_only"]["mean"] == 1.0
    top = tables["feature_label_purity"].collect()[0]
    assert top.pure_row_share == 1.0 and 0 < report["mean_abs_feature_correlation"] < 1
    assert [tuple(r) for r in tables["p_by_label"].collect()] == [(0.0, 30, 0, 0), (1.0, 0, 30, 0), (2.0, 0, 0, 30)]


def test_linear_models_with_an_absent_label_and_plain_names(spark):
    df = table(spark).selectExpr("id", "f1 a", "f2 b", "f3 reason", "y")
    f = ("a", "b", "reason")
    rows = S.stratified_folds(df, "id", "y", 2, 1).join(df.drop("y"), "id")
    oof = L.predict_folds(rows, [L.lr("lr", f), L.svm("svm", f)], "id", "y", [0, 1, 2, 3, 4]).collect()
    assert len(oof) == 2 * df.count() and {r.pred for r in oof} <= {0, 1, 2}
    assert all(sum(r.pred == r.y for r in oof if r.model == m) > 0.5 * df.count() for m in ("lr", "svm"))


def test_unfinished_fits_are_refused(spark):
    with pytest.raises(RuntimeError, match="converge"):
        L.require_converged(100, 100)


def test_svm_tells_when_it_stops_early(spark):
    rows = spark.range(60).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 2 as int) y")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="vec").transform(rows)
    with pytest.warns(RuntimeWarning, match="stopped after 2"):
        L.linear_svm(0.2, 2)(df, "y", [0, 1])


def test_linear_fits_run_in_tasks_by_rows(spark, monkeypatch):
    rows = spark.range(0, 90, 1, 30).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 3 as int) y")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="vec").transform(rows)
    seen = []
    for kind in (L.LinearSVC, L.LogisticRegression):
        real = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, d, real=real: seen.append(d.rdd.getNumPartitions()) or real(self, d))
    monkeypatch.setattr(L, "TASK_ROWS", 30)
    L.linear_svm(0.2, 5)(df, "y", [0, 1, 2])
    L.logistic()(df, "y", [0, 1, 2])
    assert seen == [2, 2, 2, 3]
