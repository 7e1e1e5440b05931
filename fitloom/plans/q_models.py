"""Model-trained queries (O*, P1-P4, P12, P14-P17, M3, M6, M7, Q9): rows-only checks.

They run on the labelled documents (quality label, text features) where a
real signal exists, fitted on split='train' and scored on split='test'.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fitloom.functions import rowwise as RW
from fitloom.operators import boosting as B
from fitloom.operators import configurations as C
from fitloom.operators import folds as N
from fitloom.operators import models as O
from fitloom.operators import select as M
from fitloom.operators import stack as S
from fitloom.operators.neural_net import fit_net
from fitloom.operators.randomized_trees import grow
from fitloom.plans.registry import register
from fitloom.session import keep_for_reuse
from fitloom.sources.frames import DOC_FEATURES, SPEND_COLS, basket, documents_frame

FEATS = DOC_FEATURES


def docs(spark, sf):
    d = keep_for_reuse(documents_frame(spark, sf))      # every fit and score reads it: the texts are parsed once
    return d, d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def docs_folds(spark, sf, k=5):
    d, tr, te = docs(spark, sf)
    return N.stratified_kfold(tr, "row_id", "label", k), te


@register("o1_logistic_regression")
def o1_logistic_regression(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.fit_predict(tr, te, "lr", FEATS)


@register("o2_boosted_trees")
def o2_boosted_trees(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.fit_predict(tr, te, "gbt", FEATS, maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8)


@register("o3_boosted_trees_early_stop")
def o3_boosted_trees_early_stop(spark, sf):
    _, tr, te = docs(spark, sf)
    tr = N.stratified_holdout(tr, "row_id", "label", 200, out="is_valid").withColumn(
        "is_valid", F.col("is_valid").cast("boolean"))
    return O.fit_predict(tr, te, "gbt", FEATS, maxIter=50, validationIndicatorCol="is_valid", validationTol=0.01)


def _patient(spark, sf):
    _, tr, te = docs(spark, sf)
    tr = keep_for_reuse(N.stratified_holdout(tr, "row_id", "label", 200, out="is_valid"))     # a fit reads it several times
    fitted = B.fit_with_patience(tr.where("is_valid = 0"), tr.where("is_valid = 1"), FEATS, rounds=80, patience=50, maxDepth=4)
    return fitted, te


@register("o3_boosted_trees_patience")
def o3_boosted_trees_patience(spark, sf):
    (model, _, _), te = _patient(spark, sf)
    out = O.positive_prob(model.transform(te))
    return out.select("row_id", F.round("prob", 12).alias("prob"), (F.col("prob") > 0.5).cast("int").alias("pred"))


@register("o3_staged_losses")
def o3_staged_losses(spark, sf):
    (_, losses, kept), _ = _patient(spark, sf)
    return B.loss_table(spark, losses, kept)


@register("o4_random_forest")
def o4_random_forest(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.fit_predict(tr, te, "rf", FEATS, numTrees=50, maxDepth=6)


@register("o5_randomized_trees")
def o5_randomized_trees(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.fit_predict(tr, te, "xt", FEATS, numTrees=50, maxDepth=6)


@register("o5_extremely_randomized_trees")
def o5_extremely_randomized_trees(spark, sf):
    _, tr, te = docs(spark, sf)
    out = te.withColumn("prob", grow(tr, FEATS, trees=50, max_depth=6).positive())
    return out.select("row_id", F.round("prob", 12).alias("prob"), (F.col("prob") > 0.5).cast("int").alias("pred"))


@register("o6_neural_net")
def o6_neural_net(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.fit_predict(tr, te, "mlp", FEATS, hidden=[16, 8], maxIter=100)


@register("o6_relu_net")
def o6_relu_net(spark, sf):
    _, tr, te = docs(spark, sf)
    out = te.withColumn("prob", fit_net(tr, FEATS, hidden=(100,), epochs=15, rate=0.01).positive())
    return out.select("row_id", F.round("prob", 9).alias("prob"), (F.col("prob") > 0.5).cast("int").alias("pred"))


@register("o7_ridge_classifier")
def o7_ridge_classifier(spark, sf):
    _, tr, te = docs(spark, sf)
    return O.ridge_classify(tr, te, FEATS, alpha=1.0)


@register("o8_sigmoid_calibration")
def o8_sigmoid_calibration(spark, sf):
    _, tr, te = docs(spark, sf)
    tr = N.stratified_holdout(tr, "row_id", "label", 200, out="cal")
    fit_part, cal_part = tr.where("cal = 0"), tr.where("cal = 1")
    model = O.fit_model(fit_part, "gbt", FEATS)
    margin = F.element_at(vector_to_array(F.col("rawPrediction")), 2)
    cal = model.transform(cal_part).withColumn("margin", margin).select("row_id", "label", "margin")
    tst = model.transform(te).withColumn("margin", margin).select("row_id", "margin")
    return O.calibrate_sigmoid(cal, tst, "margin")


@register("o9_feature_importance")
def o9_feature_importance(spark, sf):
    _, tr, _ = docs(spark, sf)
    return O.importance_table(spark, O.fit_model(tr, "rf", FEATS), FEATS)


@register("p1_oof_stack")
def p1_oof_stack(spark, sf):
    tr, te = docs_folds(spark, sf)
    return S.stack(tr, te, ["lr", "rf", "gbt"], FEATS, "fold", 5, meta="lr")


@register("p2_stack_passthrough")
def p2_stack_passthrough(spark, sf):
    tr, te = docs_folds(spark, sf)
    return S.stack(tr, te, ["lr", "rf"], FEATS, "fold", 5, meta="lr", passthrough=True)


@register("p3_tree_meta_stack")
def p3_tree_meta_stack(spark, sf):
    tr, te = docs_folds(spark, sf)
    return S.stack(tr, te, ["lr", "rf"], FEATS, "fold", 5, meta="gbt")


@register("p4_holdout_stack")
def p4_holdout_stack(spark, sf):
    _, tr, te = docs(spark, sf)
    tr = N.stratified_holdout(tr, "row_id", "label", 200)
    return S.holdout_stack(tr, te, ["lr", "rf"], FEATS, "holdout")


# The seed list of the seed ensemble.
SEEDS = [42, 123, 456, 789, 2024]


@register("p12_seed_ensemble")
def p12_seed_ensemble(spark, sf):
    _, tr, te = docs(spark, sf)
    return S.seed_ensemble(tr, te, ["rf", "lr"], FEATS, SEEDS, cluster_on=["log_len", "odd_share"])


@register("p14_pseudo_label_refit")
def p14_pseudo_label_refit(spark, sf):
    _, tr, te = docs(spark, sf)
    return S.pseudo_label_refit(tr, te, "lr", FEATS, hi=0.9, lo=0.1, min_rows=50)


CONFIGS = {"lr": ("lr", {}), "rf_shallow": ("rf", {"maxDepth": 3}), "gbt": ("gbt", {"maxIter": 10})}


@register("p15_best_config")
def p15_best_config(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    return S.scoreboard(spark, tr, CONFIGS, FEATS, "fold", 3).where("is_best = 1")


STACKS = {"original": ("lr", False, ["lr", "rf"]), "passthrough": ("lr", True, ["lr", "rf"]), "ridge": ("ridge", False, ["lr", "rf"]),
          "one_member": ("lr", False, ["rf"])}


@register("p15_best_stack")
def p15_best_stack(spark, sf):
    tr, _ = docs_folds(spark, sf, 2)
    return S.stack_scoreboard(spark, tr, STACKS, ["lr", "rf"], FEATS, "fold", 2)


def _choices():
    lr, rf, gbt = ("lr", {}), ("rf", {"maxDepth": 4, "numTrees": 20}), ("gbt", {"maxIter": 10})
    three = {"lr": lr, "rf": rf, "gbt": gbt}
    return {"single": C.Config({"gbt": gbt}, FEATS), "soft": C.Config(three, FEATS), "hard": C.Config(three, FEATS, "hard"),
            "weighted": C.Config(three, FEATS, "soft", {"lr": 1.0, "rf": 2.0, "gbt": 2.0}), "without_codes": C.Config({"gbt": gbt}, FEATS[:-2])}


@register("p15_best_ensemble")
def p15_best_ensemble(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    return C.compare_configs(spark, tr, _choices(), "fold", 3)


@register("p16_ablation")
def p16_ablation(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    sets = {"shares": ["odd_share", "digit_share", "upper_share"], "length": ["log_len", "line_count"],
            "categories": ["lang_code", "source_code"]}
    return S.ablation(spark, tr, "lr", sets, "fold", 3)


@register("p17_scoreboard")
def p17_scoreboard(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    return S.scoreboard(spark, tr, CONFIGS, FEATS, "fold", 3, metric="accuracy").orderBy(F.col("cv_mean").desc())


@register("q9_random_search")
def q9_random_search(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    return S.random_search(spark, tr, FEATS, "fold", n_iter=3)


@register("q9_continuous_search")
def q9_continuous_search(spark, sf):
    tr, _ = docs_folds(spark, sf, 3)
    ranges = {"stepSize": ("log", 0.02, 0.3), "maxDepth": ("int", 2, 5), "maxIter": ("int", 5, 20), "subsamplingRate": ("uniform", 0.6, 1.0)}
    return C.search_ranges(spark, tr, "gbt", ranges, FEATS, "fold", 3, n_iter=6)


@register("m3_importance_selection")
def m3_importance_selection(spark, sf):
    _, tr, _ = docs(spark, sf)
    return M.select_by_importance(spark, tr, FEATS)


@register("m6_recursive_elimination")
def m6_recursive_elimination(spark, sf):
    _, tr, _ = docs(spark, sf)
    return M.recursive_elimination(spark, tr, FEATS, n_keep=3, step=2)


@register("m7_adversarial_validation")
def m7_adversarial_validation(spark, sf):
    b = basket(spark, sf).withColumn("total", RW.row_sum(SPEND_COLS)).withColumn("vip_i", F.col("vip").cast("int"))
    feats = ["age", "total", "vip_i", "grp"]
    return M.adversarial_drift(spark, b.where("split = 'train'"), b.where("split = 'test'"), feats, 2)
