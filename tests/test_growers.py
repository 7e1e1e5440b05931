"""Randomised trees, nearest-neighbour information, balanced group folds, patience, blocked correlation, Ward and k-means runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.functions.ordering import ranked, running
from fitloom.operators import boosting as B
from fitloom.operators import correlation as C
from fitloom.operators import group_folds as GF
from fitloom.operators import kmeans_runs as K
from fitloom.operators import metrics as Q
from fitloom.operators import neighbours as NB
from fitloom.operators import randomized_trees as R
from fitloom.operators import ward as W
from fitloom.operators.groupstats import abs_correlation
from fitloom.sources.frames import DOC_FEATURES, documents_frame


@pytest.fixture(scope="module")
def docs(spark):
    d = documents_frame(spark, "/root/testdata/sf0.01").cache()
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = d.where("split = 'test'").drop("label").join(lab.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")
    return d.where("split = 'train'"), held


def table(spark, n, seed, width=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.7, size=n) > 0).astype(int)
    names = [f"f{i}" for i in range(width)]
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    return x, y, names, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label int").repartition(3)


# --- ordering


def test_places_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 200) // 2, rng.integers(0, 40, 200), strict=True)]
    out = ranked(spark.createDataFrame(rows, "g int, v double").repartition(5), ["g"], ["v"], block=7).collect()
    for g in {r[0] for r in rows}:
        mine = sorted(((r["rank"], r.v) for r in out if r.g == g))
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for h, v in rows if h == g)
    summed = running(spark.range(50).withColumn("g", F.lit(1)), ["g"], "id", F.col("id"), "upto", block=6).orderBy("id").collect()
    assert [r.upto for r in summed] == np.cumsum(np.arange(50)).tolist()


# --- randomised trees


def brute_tree(x, y, seed, tree, depth, most):
    """{path: (feature, cut)} and {path: share} grown row by row with the same draws."""
    splits, shares = {}, {}

    def go(rows, path, left):
        p, n = int(y[rows].sum()), len(rows)
        shares[path] = p / n
        if left == 0 or p in (0, n) or n < 2:
            return
        best = None
        for c, (f, cut) in enumerate(R.cuts_of(seed, tree, path, x[rows].min(axis=0), x[rows].max(axis=0), most)):
            side = x[rows, f] > cut
            score = sum(y[rows[s]].sum() * (s.sum() - y[rows[s]].sum()) / s.sum() for s in (side, ~side))
            if best is None or (round(score, 9), c) < best[0]:
                best = ((round(score, 9), c), f, cut, side)
        if best is None:
            return
        _, f, cut, side = best
        splits[path] = (f, cut)
        go(rows[~side], 2 * path, left - 1)
        go(rows[side], 2 * path + 1, left - 1)

    go(np.arange(len(y)), 1, depth)
    return splits, shares


def paths(tree):
    splits, shares = {}, {}

    def go(node, path):
        shares[path] = tree.share[node]
        if tree.feature[node] >= 0:
            splits[path] = (tree.feature[node], tree.cut[node])
            go(tree.left[node], 2 * path)
            go(tree.left[node] + 1, 2 * path + 1)

    go(0, 1)
    return splits, shares


def test_trees_equal_a_brute_force_grower(spark):
    x, y, names, df = table(spark, 500, 1)
    model = R.grow(df, names, trees=4, max_depth=5, seed=7)
    for t, tree in enumerate(model.trees):
        want = brute_tree(x, y, 7, t, 5, 2)
        got = paths(tree)
        assert got[0] == want[0] and got[1].keys() == want[1].keys()
        assert all(math.isclose(got[1][p], want[1][p]) for p in got[1])
    again = R.grow(df.repartition(5), names, trees=4, max_depth=5, seed=7)
    assert [paths(t) for t in again.trees] == [paths(t) for t in model.trees]
    assert abs(model.importances.sum() - 1) < 1e-9 and model.importances.argmax() == 0
    share = np.mean([t.arrays()[3][R.route(t.arrays(), x)] for t in model.trees], axis=0)
    have = model.transform(df.select("*", model.positive().alias("p"))).select(*names, "p", "prediction").toPandas()
    assert sorted(np.round(have["p"], 9)) == sorted(np.round(share, 9)) and ((have["p"] > 0.5) == (have["prediction"] == 1)).all()


def test_one_job_per_level(spark):
    _, _, names, df = table(spark, 200, 2)
    tracker, calls, plain = spark.sparkContext.statusTracker(), [], R._level
    R._level = lambda *a: calls.append(1) or plain(*a)
    try:
        R.grow(df, names, trees=3, max_depth=4)
    finally:
        R._level = plain
    assert len(calls) <= 4 and tracker is not None


def test_trees_on_documents_and_awkward_rows(spark, docs):
    tr, held = docs
    model = R.grow(tr, DOC_FEATURES, trees=40)
    out = model.transform(held).select("label", F.round(model.positive(), 12).alias("prob"))
    assert Q.auc(out, "label", "prob").first()["auc"] > 0.75
    odd = spark.createDataFrame([(None, 1.0, 1), (float("nan"), 1.0, 0), (2.0, 1.0, 1), (3.0, 1.0, 0), (3.0, 1.0, None)], "a double, b double, label int")
    model = R.grow(odd, ["a", "b"], trees=5, max_depth=3, max_features=2)
    assert model.transform(odd).count() == 5 and model.importances[1] == 0
    assert R.grow(odd.where("false"), ["a", "b"], trees=2).trees[0].feature == [-1]


# --- nearest-neighbour information


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, int(n)))


def brute_information(x, y, k):
    keep = np.array([v is not None and not math.isnan(v) and t is not None for v, t in zip(x, y, strict=True)])
    x, y = np.array([v for v, u in zip(x, keep, strict=True) if u], float), np.array([t for t, u in zip(y, keep, strict=True) if u])
    size = np.array([(y == t).sum() for t in y])
    x, y, size = x[size > 1], y[size > 1], size[size > 1]
    ks, ms = [], []
    for i in range(len(x)):
        kk = min(k, size[i] - 1)
        d = np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))
        r = d[kk - 1]
        ks.append(psi(kk))
        ms.append(psi(((x > x[i] - r) & (x < x[i] + r)).sum() if r > 0 else (x == x[i]).sum()))
    return max(0.0, psi(len(x)) + np.mean(ks) - np.mean([psi(s) for s in size]) - np.mean(ms))


def test_neighbour_information_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 1000
    y = rng.integers(0, 3, n)
    a, b, c = y + rng.normal(size=n), rng.normal(size=n), np.round(rng.normal(size=n) + y, 1)
    rows = [(float(i), float(j), float(v), int(t)) for i, j, v, t in zip(a, b, c, y, strict=True)]
    rows += [(None, float("nan"), 1.0, 1), (1.0, 2.0, 3.0, None), (0.5, 0.5, 0.5, 77), (9.0, 9.0, 9.0, 5), (9.5, 9.1, 9.0, 5)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(4)
    for block in (10, 4096):
        got = {r.feature: r.mi for r in NB.neighbour_information(df, ["a", "b", "c"], "y", 3, block).collect()}
        for k, name in enumerate("abc"):
            assert abs(got[name] - brute_information([r[k] for r in rows], [r[3] for r in rows], 3)) < 1e-6, name
    assert got["a"] > 0.2 > got["b"]


# --- balanced group folds


def one_by_one(sizes, k):
    pos, neg = np.zeros(k), np.zeros(k)
    p_all, n_all = sum(p for p, _ in sizes), sum(n for _, n in sizes)
    for p, n in sorted(sizes, key=lambda s: (-abs(s[0] - s[1]), -(s[0] + s[1]), -s[0])):
        f = min(range(k), key=lambda f: (pos[f] * p / max(p_all, 1)**2 + neg[f] * n / max(n_all, 1)**2, pos[f] + neg[f], f))
        pos[f] += p
        neg[f] += n
    return (pos / max(p_all, 1)).std() + (neg / max(n_all, 1)).std()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_folds_are_balanced(spark, seed):
    rng = np.random.default_rng(seed)
    rows, sizes = [], []
    for g in range(150):
        n, p = int(rng.integers(1, 12)) if g else 300, rng.random()
        labels = (rng.random(n) < p).astype(int).tolist()
        sizes.append((sum(labels), n - sum(labels)))
        rows += [(g, v) for v in labels]
    df = spark.createDataFrame(rows, "g int, label int").repartition(4)
    out = GF.balanced_group_kfold(spark, df, "g", "label", 5).toPandas()
    assert len(out) == len(rows) and out.groupby("g").fold.nunique().max() == 1 and set(out.fold) == set(range(5))
    share = [out[out.label == v].groupby("fold").size().reindex(range(5), fill_value=0) / (out.label == v).sum() for v in (0, 1)]
    assert sum(s.std(ddof=0) for s in share) <= one_by_one(sizes, 5) + 1e-9


def test_many_equal_groups_are_dealt_as_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(20):
        shapes = {(int(p), int(n)): int(m) for p, n, m in rng.integers(0, 9, (6, 3)) * (1, 1, 60) if p + n and m}
        dealt = GF.deal_shapes([(p, n, m) for (p, n), m in shapes.items()], 3)
        assert all(sum(dealt[s]) == m for s, m in shapes.items())
        pos, neg = (sum(np.array(dealt[s]) * s[i] for s in shapes) for i in (0, 1))
        spread = sum((x / max(x.sum(), 1)).std() for x in (pos, neg))
        assert spread <= one_by_one([s for s, m in shapes.items() for _ in range(m)], 3) + 1e-6


# --- patience


def test_best_round_has_patience():
    assert B.best_round([5, 4, 3, 3, 3, 2, 9], 10) == 6 and B.best_round([5, 4, 3, 3, 3, 2, 9], 2) == 3
    assert B.best_round([1.0], 5) == 1 and B.best_round([3, 2, 1], 1) == 3 and B.best_round([1, 2, 0], 2) == 3 and B.best_round([1, 2, 0], 1) == 1


def test_ensemble_is_cut_at_its_best_round(spark, docs):
    tr, held = docs
    tr, va = tr.where("row_id % 3 > 0"), tr.where("row_id % 3 = 0")
    model, losses, kept = B.fit_with_patience(tr, va, DOC_FEATURES, rounds=25, patience=5, maxDepth=4, stepSize=0.3)
    gbt = model.stages[-1]
    assert len(losses) == 25 and kept == B.best_round(losses, 5) and gbt.getNumTrees == kept
    seen = losses[:kept + 5]
    assert losses[kept - 1] == min(seen)
    # the loss of the cut model is that of its round, by the definition of the loss
    rows = model.transform(va).select("label", "rawPrediction").collect()
    margin, sign = np.array([r.rawPrediction[1] for r in rows]), np.array([2.0 * r.label - 1 for r in rows])
    assert abs(np.mean(2 * np.log1p(np.exp(-2 * sign * margin))) - losses[kept - 1]) < 1e-6
    assert B.loss_table(spark, losses, kept).where("kept = 1").count() == kept


# --- calibration


def test_calibration_has_smoothed_targets(spark):
    from fitloom.operators import models as O

    rng = np.random.default_rng(11)
    m = rng.normal(size=60)
    y = (m + rng.normal(scale=0.5, size=60) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(m, y, strict=True))], "row_id int, margin double, label int")
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (60 - y.sum() + 2))
    x, w = np.column_stack([m, np.ones(60)]), np.zeros(2)
    for _ in range(50):                                                    # Newton steps on the smoothed log loss
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - t))
    got = O.calibrate_sigmoid(df, df, "margin").orderBy("row_id").toPandas()["prob_calibrated"]
    assert np.allclose(got, 1 / (1 + np.exp(-x @ w)), atol=1e-5)


# --- correlation


def test_blocked_correlation_equals_the_plain_one(spark):
    _, _, names, df = table(spark, 300, 4, 7)
    df = df.withColumn("f1", F.when(F.col("f1") > 0.5, None).otherwise(F.col("f1"))).withColumn("f6", F.lit(3.0)).withColumn(
        "f5", F.col("f0") * 1e6 + 1e9)
    want = {(r.feature_a, r.feature_b): r.abs_corr for r in abs_correlation(df, names[:-1]).collect()}
    want |= {(n, "f6"): None for n in names[:-1]}
    for block in (3, 256):
        got = {(r.feature_a, r.feature_b): r.abs_corr for r in C.blocked_correlation(df, names, block).collect()}
        assert got.keys() == want.keys()
        for pair, v in want.items():
            assert got[pair] is None if v is None else abs(got[pair] - v) < 1e-9, pair


def test_many_columns(spark):
    wide = spark.range(60).select(*[(F.xxhash64("id", F.lit(i)) % 1000).alias(f"c{i}") for i in range(300)])
    out = C.blocked_correlation(wide, wide.columns, 128)
    assert out.agg(F.count(F.lit(1)).alias("n"), F.max("abs_corr").alias("m")).first()["n"] == 300 * 299 // 2


# --- Ward


def brute_ward(points):
    groups = {i: [i] for i in range(len(points))}
    out = []
    while len(groups) > 1:
        best = min(((len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum(), i, j)
                    for i, a in groups.items() for j, b in groups.items() if i < j))
        out.append(best)
        groups[best[1]] += groups.pop(best[2])
    return out


def test_ward_merges_equal_brute_force():
    points = np.random.default_rng(6).normal(size=(60, 2))
    got, want = W.ward_merges(np.ones(60), points), brute_ward(points)
    assert np.allclose([m[2] for m in got], [m[0] for m in want])
    assert [(a, b) for a, b, _ in got] == [(a, b) for _, a, b in want]


def test_ward_segments(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), float(y)) for cx, cy in ((0, 0), (10, 0), (0, 10)) for x, y in rng.normal(scale=0.5, size=(400, 2)) + (cx, cy)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    for most in (150, 5000):                # cells of a grid, then every row by itself
        fitted = W.fit_ward(spark, df, ["a", "b"], 3, most)
        out = fitted.label(df.withColumn("truth", F.when(F.col("a") > 5, 1).when(F.col("b") > 5, 2).otherwise(0))).toPandas()
        assert len(out) == 1200 and out.groupby("truth").segment.nunique().max() == 1 and out.segment.nunique() == 3
    new = fitted.label(spark.createDataFrame([(100.0, 0.0), (None, None)], "a double, b double")).toPandas()
    assert new.segment.notna().all()


# --- k-means runs


def test_runs_share_their_passes(spark):
    _, _, names, df = table(spark, 400, 9, 3)
    many = K.fit_runs(df, {"k4": (names, 4), "k6": (names[:2], 6)}, restarts=8, max_iter=6, tolerance=0.0)
    one = K.fit_runs(df, {"k4": (names, 4)}, restarts=1, max_iter=6, tolerance=0.0)
    assert many.passes <= 7 and one.passes <= 7 and len(many.costs["k4"]) == 8
    assert many.costs["k4"][0] == pytest.approx(one.costs["k4"][0]) and min(many.costs["k4"]) <= one.costs["k4"][0]
    out = many.label(df).toPandas()
    assert set(out.k4) == set(range(4)) and set(out.k6) == set(range(6)) and "__k0" not in out.columns
    # the kept run's cost is that of the labels
    z = {n: (out[n] - out[n].mean()) / out[n].std(ddof=0) for n in names}
    x = np.column_stack([z[n] for n in names])
    cost = sum(((x[out.k4 == c] - many.kept["k4"][1][c]) ** 2).sum() for c in range(4))
    assert cost == pytest.approx(min(many.costs["k4"]), rel=1e-6)
