import itertools

from pyspark.sql import functions as F

from fitloom.operators import ensemble as EN
from fitloom.operators import metrics as Q
from fitloom.operators import rules as R


def _P(spark):
    probs = {1: [0.5, 0.3, 0.7, 0.4, 0.6], 2: [0.9, 0.8, 0.95, 0.7, 0.6], 3: [0.1, 0.2, 0.6, 0.3, 0.4]}
    rows = [(r, m, p, int(p >= 0.5)) for r, ps in probs.items() for m, p in enumerate(ps)]
    return spark.createDataFrame(rows, "row_id int, member int, prob double, vote int")


def test_average_vote_hybrid(spark):
    P = _P(spark)
    avg = {r["row_id"]: (r["prob_mean"], r["pred"]) for r in EN.average_blend(P).collect()}
    assert avg[1] == (0.5, 0)                       # exactly 0.5 is not > 0.5
    maj = {r["row_id"]: r["pred"] for r in EN.majority_vote(P).collect()}
    assert maj == {1: 1, 2: 1, 3: 0}
    h = {r["row_id"]: (r["branch"], r["pred"]) for r in EN.hybrid_blend(P).collect()}
    assert h[2] == ("vote", 1) and h[1][0] == "average" and h[3] == ("vote", 0)
    conf = {r["row_id"]: r["pred"] for r in EN.confidence_vote(P).collect()}
    assert conf[2] == 1 and conf[3] == 0


def _brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (0.4, 0), (0.4, 1), (0.9, 1), (0.05, 0), (0.6, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = Q.auc(df, "y", "s").first()["auc"]
    assert abs(got - _brute_auc(rows)) < 1e-12
    got_b = Q.auc_by(df, "y", "s", buckets=3).first()["auc"]       # several scores per bucket
    assert abs(got_b - _brute_auc(rows)) < 1e-12


def test_threshold_scan_matches_brute_force(spark):
    rows = [(i / 37.0 % 1.0, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "s double, y int")
    scan = {r["t_units"]: r for r in Q.threshold_scan(df, "y", "s", 3000, 7000, 100).collect()}
    for t in range(3000, 7001, 100):
        tp = sum(1 for s, y in rows if s > t / 10000 and y)
        fp = sum(1 for s, y in rows if s > t / 10000 and not y)
        assert (scan[t]["tp"], scan[t]["fp"]) == (tp, fp)


def test_weight_search_is_exact_off_the_grid(spark):
    import random

    rng = random.Random(3)
    # six members, scores off any grid, closer together than a ten-thousandth, and a crowd of equal ones
    rows = [(i, *[rng.random() * 1e-4 if i % 3 else rng.random() for _ in range(6)], int(rng.random() < 0.4)) for i in range(300)]
    rows += [(300 + i, *[0.5] * 6, i % 2) for i in range(100)]
    cols = [f"p{m}" for m in range(6)]
    wide = spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    weights = [tuple(k / 3 for k in w) for w in Q.simplex_weights(6, 3)]
    assert len(weights) == 56 and len(set(weights)) == 56
    for range_rows in (1_000, 37):
        got = {r["w_id"]: r["auc"] for r in Q.weight_search_auc(wide, "label", cols, weights, range_rows).collect()}
        for w_id, w in enumerate(weights):
            brute = _brute_auc([(round(sum(a * b for a, b in zip(w, r[1:7])), 12), r[7]) for r in rows])
            assert abs(got[w_id] - brute) < 1e-9


def test_auc_of_crowded_and_unbounded_scores(spark):
    rows = [(1e-9 * i, i % 2) for i in range(200)] + [(-1e6, 1), (1e9, 0), (0.0, 1), (0.0, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert abs(Q.auc(df, "label", "score").first()["auc"] - _brute_auc(rows)) < 1e-9
    cuts = Q.quantile_cuts(df, "score", 16)
    sizes = [r["n"] for r in df.groupBy(Q.range_bucket(F.col("score"), cuts).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 40


def test_rules_groups_and_children(spark):
    rows = [  # group, age, state, spend, prob, pred
        (1, 30.0, True, 0.0, 0.45, False), (1, 40.0, False, 5.0, 0.8, True), (1, 3.0, False, 1.0, 0.2, False),
        (2, 25.0, False, 3.0, 0.45, True), (2, 30.0, False, 3.0, 0.1, False), (2, 35.0, False, 3.0, 0.2, False),
        (3, 50.0, False, 1.0, 0.55, True), (3, 2.0, False, 1.0, 0.9, True),
    ]
    df = spark.createDataFrame(rows, "g int, age double, state boolean, spend double, prob double, pred boolean")
    x = R.rule_state(df, "state", "spend", "prob", "pred")
    x = R.rule_group(x, "g", "prob", "pred_r1")
    x = R.rule_child(x, "g", "age", "pred_r2")
    out = {(r["g"], r["age"]): r for r in x.collect()}
    assert out[(1, 30.0)]["pred_r1"] is True and out[(1, 30.0)]["r1_override"] == 1
    # with groups of 2-3 a share >= 0.75 (<= 0.25) means every member already agrees: rule 2 never flips
    assert all(r["r2_changed"] == 0 for r in out.values()) and out[(2, 25.0)]["pred_r2"] is True
    assert out[(1, 3.0)]["pred_r3"] is True                  # child follows adults (share 1.0 > 0.7)
    assert out[(3, 2.0)]["pred_r3"] is True
    c = R.correction_counts(x, "pred", "pred_r3").first()
    assert c["n_r1"] == 1 and c["n_changed"] >= 2


def test_a_score_on_the_grid_is_not_above_its_own_threshold(spark):
    rows = [(t / 10000, i % 2) for i, t in enumerate(range(2900, 7100, 10))] + [(0.34, 0), (0.34, 1), (float("0.5600000000000001"), 1)]
    df = spark.createDataFrame(rows, "prob double, label int")
    for r in Q.threshold_scan(df, "label", "prob", 3000, 7000, 50).collect():
        t = r.t_units / 10000
        assert (r.tp, r.fp) == tuple(sum(s > t and y == v for s, y in rows) for v in (1, 0)), t
    panel = {r.t_units: r.n_pos for r in Q.threshold_panel(df, "prob", [3400, 5600, 6800], 5000).collect()}
    assert panel == {t: sum(s > t / 10000 for s, _ in rows) for t in (3400, 5600, 6800)}


def test_weight_search_merges_equal_blends_of_many_batches_before_the_shuffle():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = [pd.DataFrame(rng.integers(0, 100, (2000, 2)) / 100.0, columns=["a", "b"]).assign(label=rng.integers(0, 2, 2000)) for _ in range(20)]
    weights = [(0.3, 0.7), (0.5, 0.5)]
    parts = pd.concat(Q._blend_counts(["a", "b"], "label", weights, [np.zeros(0)] * 2)(iter(frames)))
    sent = sum(len(x) for c in parts.columns if c not in ("w_id", "rng") for x in parts[c])
    assert sent < 16 * 40_000 * 2 / 10                  # a tenth of a value and two counts per row and weight


def test_weight_search_ranges_are_even_for_every_weight(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    # six unlike members: a blend by one of them alone reaches far beyond the mean of all
    cols = [f"p{m}" for m in range(6)]
    wide = spark.range(20_000).select(*[(F.pmod(F.xxhash64("id", F.lit(m)), F.lit(1_000_003)) / 1_000_003).alias(c) for m, c in enumerate(cols)],
                                      (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("label"))
    found, real = {}, Q._blend_counts
    monkeypatch.setattr(Q, "_blend_counts", lambda *a: found.update(cuts=a[3]) or real(*a))
    weights = [(1, 0, 0, 0, 0, 0), (1 / 6,) * 6]
    got = {r["w_id"]: r["auc"] for r in Q.weight_search_auc(wide, "label", cols, weights, 1000).collect()}
    rows = np.array(wide.select(*cols, "label").collect(), float)
    cuts = found["cuts"] if len(np.shape(found["cuts"][0])) else [found["cuts"]] * 2
    for j, w in enumerate(weights):
        blend = np.round(rows[:, :6] @ np.array(w), Q.PREC)
        sizes = np.bincount(np.searchsorted(cuts[j], blend, side="left"))
        assert sizes.max() < 2500
        pos, neg = blend[rows[:, 6] == 1], np.sort(blend[rows[:, 6] == 0])
        won = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
        assert abs(got[j] - won / (len(pos) * len(neg))) < 1e-11


def test_weight_search_counts_rows_without_a_label_as_negatives(spark):
    wide = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, None), (0.2, 0), (0.9, 1)], "a double, label int")
    assert [r["auc"] for r in Q.weight_search_auc(wide, "label", ["a"], [(1.0,)]).collect()] == [0.75]


def test_weight_search_takes_many_weights_in_turns(spark, monkeypatch):
    wide = spark.createDataFrame([(i % 7 / 7, i * 5 % 11 / 11, int(i * i % 5 < 2)) for i in range(90)], "a double, b double, label int")
    weights = [(k / 10, 1 - k / 10) for k in range(11)]
    want = sorted(Q.weight_search_auc(wide, "label", ["a", "b"], weights).collect())
    sent, real = [], Q._blend_counts
    monkeypatch.setattr(Q, "SEARCH_BLENDS_AT_ONCE", 4 * 90)
    monkeypatch.setattr(Q, "SEARCH_WEIGHTS_AT_ONCE", 2)
    monkeypatch.setattr(Q, "_blend_counts", lambda *a: sent.append(len(a[2])) or real(*a))
    assert sorted(Q.weight_search_auc(wide, "label", ["a", "b"], weights).collect()) == want and len(want) == 11
    assert sent == [4, 4, 3]                               # no pass shuffles more blends than it may


def test_fits_of_many_rows_run_one_after_the_other(spark):
    from fitloom.operators.concurrent import fits_at_once

    assert [fits_at_once(spark, n) for n in (0, 100, 4_000_000, 40_000_000)] == [4, 4, 2, 1]
