"""Fits side by side, whole configurations, search over ranges, and the modelling rows without an oracle."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from fitloom.operators import configurations as C
from fitloom.operators import folds as N
from fitloom.operators import metrics as Q
from fitloom.operators import models as O
from fitloom.operators import select as M
from fitloom.operators import stack as S
from fitloom.operators.concurrent import FitsFailed, run_fits
from fitloom.sources.frames import DOC_FEATURES, documents_frame


@pytest.fixture(scope="module")
def docs(spark):
    d = documents_frame(spark, "/root/testdata/sf0.01").cache()
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = d.where("split = 'test'").drop("label").join(lab.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")
    return N.stratified_kfold(d.where("split = 'train'"), "row_id", "label", 3).cache(), d.where("split = 'test'"), held.cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_fits_overlap_and_keep_their_order_and_groups(spark):
    together = threading.Barrier(3, timeout=60)      # passes only when three fits run at the same time
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "mine")

    def fit(n):
        together.wait()
        time.sleep(0.05 * (3 - n))
        return spark.range(n).count(), spark.sparkContext.getLocalProperty("spark.jobGroup.id")

    got = run_fits(spark, {f"m{n}": lambda n=n: fit(n) for n in range(3)}, parallelism=3)
    assert got == {f"m{n}": (n, f"fit m{n}") for n in range(3)} and list(got) == ["m0", "m1", "m2"]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "mine"
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def test_failed_fits_are_named_and_the_others_kept(spark):
    def bad():
        raise ValueError("no rows")

    with pytest.raises(FitsFailed, match="second: ValueError: no rows") as e:
        run_fits(spark, {"first": lambda: 1, "second": bad, "third": lambda: 3}, parallelism=2)
    assert e.value.results == {"first": 1, "third": 3} and list(e.value.errors) == ["second"]
    assert run_fits(spark, {}) == {}


def test_side_by_side_equals_one_after_the_other(spark, docs):
    tr, _, _ = docs
    configs = {"lr": ("lr", {}), "rf": ("rf", {"maxDepth": 3, "numTrees": 10})}
    boards = []
    for workers in ("1", "4"):
        spark.conf.set("fitloom.fits.parallelism", workers)
        boards.append((rows_of(S.scoreboard(spark, tr, configs, DOC_FEATURES, "fold", 3)),
                       rows_of(S.ablation(spark, tr, "lr", {"len": ["log_len", "line_count"], "odd": ["odd_share"]}, "fold", 3))))
    spark.conf.unset("fitloom.fits.parallelism")
    assert boards[0] == boards[1]
    (lr, rf), ablated = boards[0]
    assert lr[3] + rf[3] == 1 and all(0.7 < r[1] <= 1 for r in (lr, rf))
    assert {r[0]: r[2] for r in ablated}["all"] == 0.0 and len(ablated) == 3


def test_votes_are_those_of_the_members(spark, docs):
    tr, _, _ = docs
    members = {"a": ("lr", {}), "b": ("rf", {"maxDepth": 3, "numTrees": 10}), "c": ("rf", {"maxDepth": 2, "numTrees": 5})}
    configs = {"soft": C.Config(members, DOC_FEATURES, "soft", {"a": 2.0}), "hard": C.Config(members, DOC_FEATURES, "hard"),
               "few": C.Config({"a": ("lr", {})}, ["log_len", "odd_share"])}
    got = {}
    for r in C.out_of_fold_votes(spark, tr, configs, "fold", 3).collect():
        got[r["config"], r["row_id"]] = r
    single = {}
    for name, (kind, params) in members.items():
        for f in range(3):
            for r in O.fit_predict(tr.where(F.col("fold") != f), tr.where(F.col("fold") == f), kind, DOC_FEATURES, **params).collect():
                single[name, r["row_id"]] = r
    ids = [r["row_id"] for r in tr.select("row_id").collect()]
    assert len(got) == 3 * len(ids)
    for i in ids:
        a, b, c = (single[m, i] for m in "abc")
        assert got["soft", i]["score"] == pytest.approx((2 * a["prob"] + b["prob"] + c["prob"]) / 4, abs=1e-9)
        assert got["hard", i]["pred"] == int(a["pred"] + b["pred"] + c["pred"] >= 2)
    board = {r["config"]: r for r in C.compare_configs(spark, tr, configs, "fold", 3).collect()}
    right = {f: [] for f in range(3)}
    for r in tr.select("row_id", "label", "fold").collect():
        right[r["fold"]].append(got["hard", r["row_id"]]["pred"] == r["label"])
    assert board["hard"]["cv_mean"] == pytest.approx(sum(sum(v) / len(v) for v in right.values()) / 3, abs=1e-9)
    assert sum(r["is_best"] for r in board.values()) == 1
    with pytest.raises(ValueError, match="vote"):
        C.compare_configs(spark, tr, {"x": C.Config(members, DOC_FEATURES, "loud")}, "fold", 3)


def test_draws_cover_their_ranges():
    ranges = {"u": ("uniform", 2.0, 3.0), "l": ("log", 0.001, 1.0), "i": ("int", 1, 3), "o": ("of", [5, 7])}
    sets = C.draw(ranges, 400, 1)
    assert sets == C.draw(ranges, 400, 1) and sets != C.draw(ranges, 400, 2)
    assert all(2 <= s["u"] <= 3 and 0.001 <= s["l"] <= 1 for s in sets)
    assert {s["i"] for s in sets} == {1, 2, 3} and {s["o"] for s in sets} == {5, 7}
    assert 0.4 < sum(s["l"] < 0.0316 for s in sets) / 400 < 0.6


def test_search_scores_each_draw(spark, docs):
    tr, _, _ = docs
    ranges = {"maxDepth": ("int", 1, 4), "numTrees": ("int", 3, 8)}
    board = C.search_ranges(spark, tr, "rf", ranges, DOC_FEATURES, "fold", 3, n_iter=3).collect()
    best = max(board, key=lambda r: r["cv_mean"])
    assert best["is_best"] == 1 and sum(r["is_best"] for r in board) == 1
    p = {k: int(v) for k, v in board[1]["params"].items()}
    alone = O.cv_metric(tr, "fold", 3, lambda a, b: O.fit_predict(a, b, "rf", DOC_FEATURES, keep=("row_id", "label"), **p))
    assert board[1]["cv_mean"] == pytest.approx(sum(alone) / 3, abs=1e-12)


@pytest.mark.parametrize("meta,through", [("lr", True), ("gbt", False)])
def test_stacks_find_the_signal(docs, meta, through):
    tr, _, held = docs
    out = S.stack(tr, held, ["lr", "rf"], DOC_FEATURES, "fold", 3, meta=meta, passthrough=through).join(held.select("row_id", "label"), "row_id")
    assert out.count() == held.count() and Q.auc(out, "label", "prob").first()["auc"] > 0.75


def test_holdout_stack_and_pseudo_labels(docs):
    tr, te, held = docs
    out = S.holdout_stack(N.stratified_holdout(tr, "row_id", "label", 200), held, ["lr", "rf"], DOC_FEATURES, "holdout")
    assert Q.auc(out.join(held.select("row_id", "label"), "row_id"), "label", "prob").first()["auc"] > 0.75
    first = O.fit_predict(tr, te, "lr", DOC_FEATURES)
    second = S.pseudo_label_refit(tr, te, "lr", DOC_FEATURES, min_rows=1)
    assert second.count() == te.count() and rows_of(first) != rows_of(second)
    none = S.pseudo_label_refit(tr, te, "lr", DOC_FEATURES, min_rows=10**9)
    a, b = ({r["row_id"]: r["prob"] for r in d.collect()} for d in (first, none))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_importances_choose_features(spark, docs):
    tr, _, _ = docs
    noisy = tr.withColumn("noise", F.lit(1.0))
    table = {r["feature"]: r for r in M.select_by_importance(spark, noisy, [*DOC_FEATURES, "noise"]).collect()}
    assert sum(r["importance"] for r in table.values()) == pytest.approx(1.0) and table["noise"]["selected"] == 0
    assert sum(r["selected"] for r in table.values()) >= len(table) / 2
    left = {r["feature"]: r for r in M.recursive_elimination(spark, noisy, [*DOC_FEATURES, "noise"], 3, 2).collect()}
    assert sum(r["selected"] for r in left.values()) == 3 and left["noise"]["dropped_round"] == 1
    drift = M.adversarial_drift(spark, tr, tr.withColumn("log_len", F.col("log_len") + 100), DOC_FEATURES, 1).collect()
    assert [r["feature"] for r in drift if r["dropped"]] == ["log_len"]
