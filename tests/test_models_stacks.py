"""Models, stacks, clusters: metric bands, closed forms, same seed same rows, no fold leak."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.functions import parse as P
from fitloom.functions.quantiles import exact_quantiles, group_quantiles
from fitloom.operators import cluster as L
from fitloom.operators import folds as N
from fitloom.operators import groupstats as G
from fitloom.operators import impute as D
from fitloom.operators import metrics as Q
from fitloom.operators import models as O
from fitloom.operators import stack as S
from fitloom.plans.q_models import SEEDS
from fitloom.sources.frames import DOC_FEATURES, documents_frame


@pytest.fixture(scope="module")
def docs(spark):
    d = documents_frame(spark, "/root/testdata/sf0.01").cache()
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = d.where("split = 'test'").drop("label").join(lab.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")
    return d, d.where("split = 'train'"), d.where("split = 'test'"), held


def test_every_document_outside_the_fit_is_scored(spark, docs):
    d, tr, te, _ = docs
    assert d.count() == 1000 and tr.where("label is null").count() == 0
    assert te.count() == 1000 - tr.count() and te.where("label is null").count() == 601
    assert O.fit_predict(tr, te, "rf", DOC_FEATURES, numTrees=10).count() == te.count()


@pytest.mark.parametrize("kind", ["lr", "gbt", "rf", "xt", "mlp"])
def test_models_find_the_quality_signal(docs, kind):
    _, tr, _, held = docs
    kw = {"gbt": {"maxIter": 10}, "mlp": {"maxIter": 60}}.get(kind, {})
    out = O.fit_predict(tr, held, kind, DOC_FEATURES, keep=("row_id", "label"), **kw)
    assert Q.auc(out, "label", "prob").first()["auc"] > 0.75


def test_ridge_matches_the_normal_equations(docs):
    _, tr, _, held = docs
    feats = ["log_len", "odd_share", "line_count"]
    t = tr.select("label", *feats).toPandas()
    x, y = t[feats].to_numpy(float), t["label"].to_numpy(float) * 2 - 1
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    h = held.select("row_id", *feats).toPandas().set_index("row_id")
    want = (h[feats].to_numpy(float) - x.mean(0)) @ w + y.mean()
    got = O.ridge_classify(tr, held, feats, alpha=1.0).toPandas().set_index("row_id").loc[h.index]
    assert np.allclose(got["margin"], want, atol=1e-6)


def test_logistic_strength_is_the_inverse_penalty(docs):
    _, tr, _, _ = docs
    feats = ["log_len", "odd_share"]
    t = tr.select("label", *feats).toPandas()
    x, y = t[feats].to_numpy(float), t["label"].to_numpy(float)
    for c in (0.1, 1.0):
        m = O.fit_model(tr, "lr", feats, C=c, maxIter=500).stages[-1]
        p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
        assert np.allclose(m.coefficients.toArray(), c * x.T @ (y - p), atol=0.02)


def test_seeds_repeat_and_differ(docs):
    _, tr, te, _ = docs
    a, b = (S.seed_ensemble(tr, te, ["rf", "lr"], DOC_FEATURES, SEEDS[:2], cluster_on=["log_len", "odd_share"]).toPandas()
            .sort_values(["row_id", "member"], ignore_index=True) for _ in range(2))
    assert a.equals(b) and set(a["member"]) == {0, 1, 2, 3}
    assert (a[a["member"] == 0].prob.to_numpy() != a[a["member"] == 2].prob.to_numpy()).any()


def test_stack_is_out_of_fold(docs):
    _, tr, te, held = docs
    tr = N.stratified_kfold(tr, "row_id", "label", 3)
    o, t = S.oof_predictions(tr, te, ["lr"], DOC_FEATURES, "fold", 3)
    assert o.count() == tr.count() and t.count() == te.count()
    part = tr.where("fold = 1")
    alone = O.fit_predict(tr.where("fold != 1"), part, "lr", DOC_FEATURES).select("row_id", "prob")
    diff = o.join(alone, "row_id").agg(F.max(F.abs(F.col("lr") - F.col("prob")))).first()[0]
    assert diff < 1e-6
    out = S.stack(tr, held, ["lr", "rf"], DOC_FEATURES, "fold", 3)
    assert out.count() == held.count()


def test_stack_scoreboard_ranks_every_stack(spark, docs):
    _, tr, _, _ = docs
    board = S.stack_scoreboard(spark, N.stratified_kfold(tr, "row_id", "label", 2), {"lr": ("lr", False, ["lr"]), "ridge": ("ridge", True, ["lr"])},
                               ["lr"], DOC_FEATURES, "fold", 2).collect()
    assert {r["config"] for r in board} == {"lr", "ridge"} and sum(r["is_best"] for r in board) == 1
    assert all(0.7 < r["cv_mean"] <= 1 for r in board)


def test_clusters_repeat_and_cover(docs):
    _, tr, te, _ = docs
    views = [("a", ["log_len"], 3), ("b", ["odd_share", "line_count"], 4)]
    a = L.multiview(tr, te, views).select("row_id", "cl_a", "cl_b").toPandas().sort_values("row_id", ignore_index=True)
    b = L.multiview(tr, te, views).select("row_id", "cl_a", "cl_b").toPandas().sort_values("row_id", ignore_index=True)
    assert a.equals(b) and a["cl_a"].between(0, 2).all() and a["cl_b"].between(0, 3).all()


def test_models_refuse_missing_features(spark, docs):
    _, tr, _, _ = docs
    with pytest.raises(Exception):
        O.fit_model(tr.withColumn("log_len", F.lit(None).cast("double")), "rf", DOC_FEATURES, numTrees=2)


# fits on awkward numbers


def test_quantiles_skip_nan_and_count_infinities(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v, "g") for v in (1.0, 2.0, nan, 4.0, None)], "x double, k string")
    assert exact_quantiles(df, "x", [0.5]) == [2.0]
    assert group_quantiles(df, "k", "x", [0.5], ["m"]).first()["m"] == 2.0
    wide = spark.createDataFrame([(float(i),) for i in range(100)] + [(inf,)] * 3 + [(-inf,)] * 2 + [(1.7e308,), (-1.7e308,)], "x double")
    assert exact_quantiles(wide, "x", [0.0, 0.5, 1.0], bins=8, max_collect=4) == [-inf, 50.0, inf]


def test_parsing_of_awkward_numbers(spark):
    rows = [("1d",), ("nan",), ("Infinity",), (" 1.5 ",), ("-2e3",), ("",), (None,), (".5",), ("5.",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(P.to_number("s")).collect()]
    assert got == [None, None, None, 1.5, -2000.0, None, None, 0.5, 5.0]
    assert spark.createDataFrame([("\t a b",)], "s string").select(P.first_token("s")).first()[0] == "a"
    big = spark.createDataFrame([(9007199254740993,), (-7,), (7,)], "n long")
    assert [r[0] for r in big.select(P.int_div("n", 1)).collect()] == [9007199254740993, -7, 7]
    assert [r[0] for r in big.select(P.int_div("n", 2)).collect()] == [4503599627370496, -4, 3]


def test_group_aggregates_round_half_to_even(spark):
    df = spark.createDataFrame([("a", 0.125), ("b", 0.375)], "k string, x double")
    got = {r["k"]: r["x_mean"] for r in G.group_agg(df, "k", {"x": ["mean"]}, decimals=2).collect()}
    assert got == {"a": 0.12, "b": 0.38}


def test_vip_is_decided_after_the_state_repair(spark):
    rows = [(1, "true", None, 2000.0), (2, "false", None, 2000.0), (3, None, None, 2000.0), (4, None, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, state string, vip string, spend double").withColumn("age", F.lit(1.0)).withColumn("grp", F.lit(1))
    df = df.withColumn("cat", F.lit("x")).withColumn("dest", F.lit("y"))
    out = D.rule_cascade(df, ["spend"], "state", "vip", "age", "grp", ("cat", "dest"), {"y": "x"}, "z")
    assert {r["id"]: (r["state_r"], r["vip_r"]) for r in out.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (1, 0)}


def test_out_of_fold_scores_read_each_part_once_for_all_kinds(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 5) / 3.0, i // 2 % 2) for i in range(60)], "row_id long, label int, x double, fold int")
    o, t = S.oof_predictions(rows, rows.drop("fold"), ["lr", "rf"], ["x"], "fold", 2)
    assert o.columns == t.columns == ["row_id", "lr", "rf"]
    for found, parts in ((o, 2), (t, 2)):                 # a part per fold, not per fold and kind
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= parts
        assert found.count() == 60


def test_text_features_remove_runs_and_count_lines_natively(spark, tmp_path):
    import re

    from fitloom.sources.frames import documents_frame

    texts = [None, "", "\n", "a\n\nb\n", "AB12 é😀x-3", "😀😀", "١٢ ÀB", "  A9\r\nZ"]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = documents_frame(spark, str(tmp_path))
    for r in found.collect():
        t, n = texts[r["row_id"]], max(len(texts[r["row_id"]] or ""), 1)
        shares = [len(re.sub(p, "", t or "")) / n for p in ("[a-zA-Z0-9 ]", "[^0-9]", "[^A-Z]")]
        assert [r["odd_share"], r["digit_share"], r["upper_share"]] == shares
        assert r["line_count"] == (1 if t is None else t.count("\n") + 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[^0-9]+" in plan and "split(text" not in plan         # not one match per character, no array of lines
