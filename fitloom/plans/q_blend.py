"""Queries for blending (P5-P11, P13, P18), metrics / searches (Q*) and rules (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.operators import ensemble as EN
from fitloom.operators import folds as N
from fitloom.operators import metrics as Q
from fitloom.operators import rules as R
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import basket, line, preds
from fitloom.sources.tables import table

# Member weights and member scores used by the weighted blends.
MEMBER_WEIGHTS = {0: 1.0, 1: 2.0, 2: 1.5, 3: 0.5, 4: 1.0}
MEMBER_SCORES = {0: 0.801, 1: 0.805, 2: 0.808, 3: 0.79, 4: 0.81}


def _case(mapping, col="member"):
    return "CASE " + " ".join(f"WHEN {col} = {k} THEN {float(v)!r}" for k, v in mapping.items()) + " END"


@register("p5_average_blend", with_frames("preds", """
SELECT row_id, prob_mean, CAST(prob_mean > 0.5 AS INTEGER) AS pred
FROM (SELECT row_id, round(avg(prob), 12) AS prob_mean FROM preds GROUP BY row_id)"""))
def p5_average_blend(spark, sf):
    return EN.average_blend(preds(spark, sf))


@register("p6_weighted_soft_vote", with_frames("preds", f"""
SELECT row_id, prob_w, CAST(prob_w > 0.5 AS INTEGER) AS pred FROM (
  SELECT row_id, round(sum(({_case(MEMBER_WEIGHTS)}) * prob) / sum({_case(MEMBER_WEIGHTS)}), 12) AS prob_w
  FROM preds GROUP BY row_id)"""))
def p6_weighted_soft_vote(spark, sf):
    return EN.weighted_blend(preds(spark, sf), MEMBER_WEIGHTS)


@register("p7_majority_vote", with_frames("preds", """
SELECT row_id, vote_share, CAST(vote_share >= 0.5 AS INTEGER) AS pred
FROM (SELECT row_id, round(avg(CAST(vote AS DOUBLE)), 12) AS vote_share FROM preds GROUP BY row_id)"""))
def p7_majority_vote(spark, sf):
    return EN.majority_vote(preds(spark, sf))


_TOT = sum(MEMBER_SCORES.values())
_NORM = {m: s / _TOT for m, s in MEMBER_SCORES.items()}


@register("p8_score_weighted", with_frames("preds", f"""
SELECT row_id, prob_w, CAST(prob_w > 0.5 AS INTEGER) AS pred FROM (
  SELECT row_id, round(sum(({_case(_NORM)}) * prob) / sum({_case(_NORM)}), 12) AS prob_w FROM preds GROUP BY row_id)"""))
def p8_score_weighted(spark, sf):
    return EN.score_weighted(preds(spark, sf), MEMBER_SCORES)


@register("p9_confidence_vote", with_frames("preds", """
SELECT row_id, conf_score, CAST(conf_score > 0 AS INTEGER) AS pred FROM (
  SELECT row_id, round(sum(CASE WHEN prob > 0.5 THEN abs(prob - 0.5) * 2 ELSE -(abs(prob - 0.5) * 2) END), 12) + 0.0
    AS conf_score FROM preds GROUP BY row_id)"""))
def p9_confidence_vote(spark, sf):
    return EN.confidence_vote(preds(spark, sf))


_HYB = """h AS (SELECT row_id, round(avg(CAST(vote AS DOUBLE)), 12) AS agreement, round(avg(prob), 12) AS prob_mean
          FROM preds GROUP BY row_id),
hb AS (SELECT row_id, agreement, prob_mean,
  CASE WHEN agreement >= 0.8 OR agreement <= 0.2 THEN 'vote' ELSE 'average' END AS branch,
  CAST(CASE WHEN agreement >= 0.8 OR agreement <= 0.2 THEN agreement >= 0.5 ELSE prob_mean >= 0.5 END AS INTEGER) AS pred
  FROM h)"""


@register("p10_hybrid_blend", with_frames("preds", _HYB + " SELECT * FROM hb"))
def p10_hybrid_blend(spark, sf):
    return EN.hybrid_blend(preds(spark, sf))


@register("p10_hybrid_branch_counts", with_frames("preds", _HYB + " SELECT branch, count(*) AS n FROM hb GROUP BY branch"))
def p10_hybrid_branch_counts(spark, sf):
    return EN.branch_counts(EN.hybrid_blend(preds(spark, sf)))


@register("p11_prune_members", with_frames("preds", """
c AS (SELECT row_id, avg(CAST(vote AS DOUBLE)) AS c FROM preds GROUP BY row_id),
d AS (SELECT member, round(avg(abs(vote - c)), 12) AS deviation FROM preds JOIN c USING (row_id) GROUP BY member),
k AS (SELECT member FROM d ORDER BY deviation, member LIMIT 3)
SELECT row_id, vote_share, CAST(vote_share >= 0.5 AS INTEGER) AS pred FROM (
  SELECT row_id, round(avg(CAST(vote AS DOUBLE)), 12) AS vote_share FROM preds JOIN k USING (member) GROUP BY row_id)"""))
def p11_prune_members(spark, sf):
    return EN.prune_and_vote(preds(spark, sf), 3)


@register("p13_majority_of_sets", with_frames("preds", """
SELECT row_id, vote_share, CAST(vote_share > 0.5 AS INTEGER) AS pred
FROM (SELECT row_id, round(avg(CAST(vote AS DOUBLE)), 12) AS vote_share FROM preds GROUP BY row_id)"""))
def p13_majority_of_sets(spark, sf):
    p = preds(spark, sf)
    return EN.majority_of([p.where(F.col("member") == m).select("row_id", "vote") for m in range(5)])


@register("p18_fold_average", with_frames("preds", """
SELECT row_id, round(sum(prob) / 5, 12) AS prob_fold_avg FROM preds GROUP BY row_id"""))
def p18_fold_average(spark, sf):
    return EN.fold_average(preds(spark, sf), 5)


# ---------------------------------------------------------------- Q*

SCORED = """sc AS (SELECT id, label, prob, vote FROM basket JOIN preds ON id = row_id AND member = 0)"""
MD5 = "md5(CAST(id AS VARCHAR))"


def scored(spark, sf):
    b = basket(spark, sf).select("id", "label")
    p = preds(spark, sf).where("member = 0").select(F.col("row_id").alias("id"), "prob", "vote")
    return b.join(p, "id")


@register("q1_fold_accuracy", with_frames("basket preds", f"""
{SCORED},
f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {MD5}) - 1) % 5 AS fold FROM sc),
a AS (SELECT fold, avg(CAST(label = vote AS DOUBLE)) AS acc FROM f GROUP BY fold)
SELECT round(avg(acc), 12) AS acc_mean, round(stddev_pop(acc), 12) AS acc_std, count(*) AS n_folds FROM a"""))
def q1_fold_accuracy(spark, sf):
    d = N.stratified_kfold(scored(spark, sf), "id", "label", 5)
    return Q.fold_accuracy(d, "label", "vote", "fold")


def _auc_sql(src, score, label):
    return f"""
s AS (SELECT {score} AS s, sum(CAST({label} AS BIGINT)) AS p, sum(CAST(1 - {label} AS BIGINT)) AS n FROM {src} GROUP BY 1),
w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(CAST(p AS DOUBLE) * (CAST(below AS DOUBLE) + n / 2.0)) / (sum(p) * sum(n)), 12) AS auc,
       CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM w"""


@register("q2_auc", with_frames("basket preds", f"{SCORED},{_auc_sql('sc', 'prob', 'label')}"))
def q2_auc(spark, sf):
    return Q.auc(scored(spark, sf), "label", "prob")


@register("q2_auc_by_member", with_frames("basket preds", """
s AS (SELECT member, prob AS s, sum(CAST(label AS BIGINT)) AS p, sum(CAST(1 - label AS BIGINT)) AS n
      FROM basket JOIN preds ON id = row_id GROUP BY 1, 2),
w AS (SELECT member, p, n, coalesce(sum(n) OVER (PARTITION BY member ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT member, round(sum(CAST(p AS DOUBLE) * (CAST(below AS DOUBLE) + n / 2.0)) / (sum(p) * sum(n)), 12) AS auc,
       CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM w GROUP BY member"""))
def q2_auc_by_member(spark, sf):
    b = basket(spark, sf).select(F.col("id").alias("row_id"), "label")
    return Q.auc_by(b.join(preds(spark, sf), "row_id"), "label", "prob", ["member"])


def text_signal(spark, sf):
    """documents joined to labels with the share of characters outside [a-zA-Z0-9 ] (whole text)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    share = F.length(F.regexp_replace("text", "[a-zA-Z0-9 ]", "")) / F.greatest(F.length("text"), F.lit(1))
    return d.join(lab, "doc_id").select("doc_id", "quality", "toxic", F.round(share, 9).alias("odd_share"))


_TEXT_SQL = """t AS (SELECT doc_id, quality, toxic,
  round(length(regexp_replace(text, '[a-zA-Z0-9 ]', '', 'g')) / greatest(length(text), 1), 9) AS odd_share
  FROM documents JOIN labels USING (doc_id))"""


@register("q2_auc_text_signal", f"WITH {_TEXT_SQL},{_auc_sql('t', 'odd_share', 'quality')}")
def q2_auc_text_signal(spark, sf):
    return Q.auc(text_signal(spark, sf), "quality", "odd_share")


@register("q3_f1", with_frames("basket preds", f"""
{SCORED},
c AS (SELECT count(*) FILTER (WHERE label = 1 AND vote = 1) AS tp, count(*) FILTER (WHERE label = 0 AND vote = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND vote = 0) AS fn FROM sc)
SELECT tp, fp, fn, round(2.0 * tp / (2.0 * tp + fp + fn), 12) AS f1 FROM c"""))
def q3_f1(spark, sf):
    return Q.f1(scored(spark, sf), "label", "vote")


@register("q4_classification_report", with_frames("basket preds", f"""
{SCORED},
c AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND vote = 1) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (WHERE label = 0 AND vote = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE label = 0 AND vote = 0) AS DOUBLE) AS tn,
             CAST(count(*) FILTER (WHERE label = 1 AND vote = 0) AS DOUBLE) AS fn FROM sc),
m AS (SELECT tp, fp, tn, fn,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
  coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0 FROM c),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0,
  tp + fn AS s1, tn + fp AS s0 FROM m)
SELECT klass, round(precision, 12) AS precision, round(recall, 12) AS recall, round(f1, 12) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS klass, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                   (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (s0 + s1), s0 + s1 FROM f)"""))
def q4_classification_report(spark, sf):
    return Q.classification_report(scored(spark, sf), "label", "vote")


def _scan_sql(lo, hi, step):
    return f"""
{SCORED},
g AS (SELECT CAST(t AS INTEGER) AS t_units FROM range({lo}, {hi + 1}, {step}) r(t)),
c AS (SELECT t_units, count(*) FILTER (WHERE prob > t_units / 10000.0::DOUBLE AND label = 1) AS tp,
             count(*) FILTER (WHERE prob > t_units / 10000.0::DOUBLE AND label = 0) AS fp,
             count(*) FILTER (WHERE NOT (prob > t_units / 10000.0::DOUBLE) AND label = 0) AS tn,
             count(*) FILTER (WHERE NOT (prob > t_units / 10000.0::DOUBLE) AND label = 1) AS fn
      FROM g CROSS JOIN sc GROUP BY t_units),
m AS (SELECT *, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0), 12) AS f1,
  round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 12) AS accuracy,
  round(CAST(tp + fp AS DOUBLE) / (tp + fp + tn + fn), 12) AS pos_rate FROM c)"""


@register("q5_threshold_scan", with_frames("basket preds", _scan_sql(3000, 7000, 100) + " SELECT * FROM m"))
def q5_threshold_scan(spark, sf):
    return Q.with_threshold_metrics(Q.threshold_scan(scored(spark, sf), "label", "prob", 3000, 7000, 100))


@register("q5_best_threshold_f1", with_frames("basket preds", _scan_sql(3000, 7000, 100)
                                              + " SELECT t_units, 'f1' AS metric, f1 AS value FROM m ORDER BY f1 DESC, t_units LIMIT 1"))
def q5_best_threshold_f1(spark, sf):
    return Q.best_threshold(scored(spark, sf), "label", "prob", 3000, 7000, 100, "f1")


@register("q5_best_threshold_accuracy", with_frames("basket preds", _scan_sql(4000, 6000, 100)
          + " SELECT t_units, 'accuracy' AS metric, accuracy AS value FROM m ORDER BY accuracy DESC, t_units LIMIT 1"))
def q5_best_threshold_accuracy(spark, sf):
    return Q.best_threshold(scored(spark, sf), "label", "prob", 4000, 6000, 100, "accuracy")


@register("q5_best_threshold_accuracy_fine", with_frames("basket preds", _scan_sql(4500, 5500, 10)
          + " SELECT t_units, 'accuracy' AS metric, accuracy AS value FROM m ORDER BY accuracy DESC, t_units LIMIT 1"))
def q5_best_threshold_accuracy_fine(spark, sf):
    """Accuracy over 0.450 .. 0.550 by 0.001 (101 thresholds) in the same single bucket pass."""
    return Q.best_threshold(scored(spark, sf), "label", "prob", 4500, 5500, 10, "accuracy")


_PANEL = [4000, 4500, 5500, 6000]


@register("q6_threshold_panel", with_frames("preds", """
a AS (SELECT row_id, round(avg(prob), 12) AS p FROM preds GROUP BY row_id),
c AS (SELECT count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE p > {t} / 10000.0::DOUBLE) AS c{t}" for t in _PANEL + [5000])
    + """ FROM a)
""" + " UNION ALL ".join(
    f"SELECT {t} AS t_units, c{t} AS n_pos, round(c{t} / n, 12) AS pos_rate, abs(c{t} - c5000) AS n_changed FROM c"
    for t in _PANEL)))
def q6_threshold_panel(spark, sf):
    avg = EN.average_blend(preds(spark, sf))
    return Q.threshold_panel(avg, "prob_mean", _PANEL, 5000)


_SIMPLEX = Q.simplex_weights(5, 10)


@register("q7_blend_weight_auc", with_frames("basket preds", """
w AS (SELECT CAST(row_number() OVER (ORDER BY k0, k1, k2, k3, k4) - 1 AS INTEGER) AS w_id,
        k0 / 10.0 AS w0, k1 / 10.0 AS w1, k2 / 10.0 AS w2, k3 / 10.0 AS w3, k4 / 10.0 AS w4
      FROM range(11) a(k0), range(11) b(k1), range(11) c(k2), range(11) d(k3), range(11) e(k4)
      WHERE k0 + k1 + k2 + k3 + k4 = 10),
wide AS (SELECT row_id, max(CASE WHEN member = 0 THEN prob END) AS p0, max(CASE WHEN member = 1 THEN prob END) AS p1,
  max(CASE WHEN member = 2 THEN prob END) AS p2, max(CASE WHEN member = 3 THEN prob END) AS p3,
  max(CASE WHEN member = 4 THEN prob END) AS p4 FROM preds GROUP BY row_id),
x AS (SELECT w_id, label, round(w0 * p0 + w1 * p1 + w2 * p2 + w3 * p3 + w4 * p4, 9) AS s
      FROM wide JOIN basket ON row_id = id CROSS JOIN w),
s AS (SELECT w_id, s, sum(CAST(label AS BIGINT)) AS p, sum(CAST(1 - label AS BIGINT)) AS n FROM x GROUP BY 1, 2),
b AS (SELECT w_id, p, n, coalesce(sum(n) OVER (PARTITION BY w_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT w_id, round(sum(CAST(p AS DOUBLE) * (CAST(below AS DOUBLE) + n / 2.0)) / (sum(p) * sum(n)), 12) AS auc FROM b GROUP BY w_id"""))
def q7_blend_weight_auc(spark, sf):
    wide = EN.to_wide(preds(spark, sf), range(5)).join(basket(spark, sf).select(F.col("id").alias("row_id"), "label"), "row_id")
    weights = [tuple(k / 10 for k in w) for w in _SIMPLEX]
    return Q.weight_search_auc(wide, "label", [f"p{m}" for m in range(5)], weights)


# Six members whose scores lie off any grid, weights in quarters.
_SIX = Q.simplex_weights(6, 4)
_SIX_SQL = ", ".join("(" + ", ".join([str(i)] + [repr(k / 4) for k in w]) + ")" for i, w in enumerate(_SIX))


@register("q7_blend_weight_auc_six", with_frames("basket", f"""
w(w_id, {', '.join(f'w{m}' for m in range(6))}) AS (VALUES {_SIX_SQL}),
wide AS (SELECT label, {', '.join(f'(((id * {7919 + 2 * m}) % 100003) / 100003.0)::DOUBLE AS p{m}' for m in range(6))} FROM basket),
x AS (SELECT w_id, label, round({' + '.join(f'w{m} * p{m}' for m in range(6))}, 12) AS s FROM wide CROSS JOIN w),
s AS (SELECT w_id, s, sum(CAST(label AS BIGINT)) AS p, sum(CAST(1 - label AS BIGINT)) AS n FROM x GROUP BY 1, 2),
b AS (SELECT w_id, p, n, coalesce(sum(n) OVER (PARTITION BY w_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT CAST(w_id AS INTEGER) AS w_id, round(sum(CAST(p AS DOUBLE) * (CAST(below AS DOUBLE) + n / 2.0)) / (sum(p) * sum(n)), 12) AS auc FROM b GROUP BY w_id"""))
def q7_blend_weight_auc_six(spark, sf):
    b = basket(spark, sf)
    wide = b.select("label", *[((F.col("id") * (7919 + 2 * m)) % 100003 / 100003.0).alias(f"p{m}") for m in range(6)])
    return Q.weight_search_auc(wide, "label", [f"p{m}" for m in range(6)], [tuple(k / 4 for k in w) for w in _SIX])


_GRID = Q.normalised_grid([0.8, 1.0, 1.2, 1.5], 4)
_GRID_SQL = ", ".join("(" + ", ".join([str(i)] + [repr(x) for x in w]) + ")" for i, w in enumerate(_GRID))


@register("q8_blend_weight_accuracy", with_frames("basket preds", f"""
w(w_id, w0, w1, w2, w3) AS (VALUES {_GRID_SQL}),
wide AS (SELECT row_id, max(CASE WHEN member = 0 THEN prob END) AS p0, max(CASE WHEN member = 1 THEN prob END) AS p1,
  max(CASE WHEN member = 2 THEN prob END) AS p2, max(CASE WHEN member = 3 THEN prob END) AS p3 FROM preds GROUP BY row_id)
SELECT CAST(w_id AS INTEGER) AS w_id,
  round(avg(CAST(CAST(round(w0 * p0 + w1 * p1 + w2 * p2 + w3 * p3, 12) > 0.5 AS INTEGER) = label AS DOUBLE)), 12) AS accuracy
FROM wide JOIN basket ON row_id = id CROSS JOIN w GROUP BY w_id"""))
def q8_blend_weight_accuracy(spark, sf):
    wide = EN.to_wide(preds(spark, sf), range(4)).join(basket(spark, sf).select(F.col("id").alias("row_id"), "label"), "row_id")
    return Q.weight_search_accuracy(wide, "label", [f"p{m}" for m in range(4)], _GRID)


@register("q10_agreement_stats", with_frames("preds", """
a AS (SELECT row_id, min(vote) = max(vote) AS u, round(avg(prob), 12) AS p FROM preds GROUP BY row_id)
SELECT count(*) FILTER (WHERE u) AS n_unanimous, count(*) FILTER (WHERE p < 0.3 OR p > 0.7) AS n_confident,
  count(*) FILTER (WHERE p > 0.9) AS n_very_high, count(*) FILTER (WHERE p < 0.7) AS n_below_07,
  count(*) FILTER (WHERE p >= 0.4 AND p <= 0.6) AS n_uncertain, count(*) AS n_rows FROM a"""))
def q10_agreement_stats(spark, sf):
    return Q.agreement_stats(preds(spark, sf))


@register("q11_rule_compliance", with_frames("basket", """
c AS (SELECT count(*) FILTER (WHERE coalesce(state_n, false)) AS n_applicable,
  count(*) FILTER (WHERE coalesce(state_n, false) AND coalesce((coalesce(sp_economy, 0.0) + coalesce(sp_large, 0.0)
    + coalesce(sp_medium, 0.0) + coalesce(sp_promo, 0.0) + coalesce(sp_small, 0.0)) = 0, false)) AS n_valid FROM basket)
SELECT n_applicable, n_valid, n_applicable - n_valid AS n_violation,
  round(CAST(n_valid AS DOUBLE) / nullif(n_applicable, 0), 12) AS share_valid FROM c"""))
def q11_rule_compliance(spark, sf):
    from fitloom.functions.rowwise import row_sum
    from fitloom.sources.frames import SPEND_COLS

    return Q.rule_compliance(basket(spark, sf), F.col("state_n"), row_sum(SPEND_COLS) == 0)


# ---------------------------------------------------------------- R*

LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LK = ", ".join(LKEY)


def line_scored(spark, sf):
    li = line(spark, sf)
    score = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 211
             + F.col("l_suppkey") * 31) % 1000
    prob = score.cast("double") / 1000.0
    return li.select(*LKEY, "l_quantity", (F.col("l_linestatus") == "F").alias("state"),
                     F.col("l_discount").alias("spend"), prob.alias("prob"), (prob > 0.5).alias("pred0"))


_LS = f"""ls AS (SELECT {LK}, l_quantity, l_linestatus = 'F' AS state, l_discount AS spend,
  CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 211 + l_suppkey * 31) % 1000 AS DOUBLE) / 1000.0 AS prob
  FROM lineitem),
l0 AS (SELECT *, prob > 0.5 AS pred0 FROM ls),
r1 AS (SELECT *, CASE WHEN h THEN true ELSE pred0 END AS pred_r1, CAST(h AS INTEGER) AS r1_override FROM (
  SELECT *, coalesce(state AND spend = 0 AND prob > 0.3 AND prob < 0.7, false) AS h FROM l0)),
g2 AS (SELECT l_orderkey, count(*) AS gs, avg(CAST(pred_r1 AS DOUBLE)) AS share FROM r1 GROUP BY l_orderkey),
r2 AS (SELECT r1.*, gs, CASE WHEN gs BETWEEN 2 AND 3 AND prob > 0.4 AND prob < 0.6 AND share >= 0.75 THEN true
  WHEN gs BETWEEN 2 AND 3 AND prob > 0.4 AND prob < 0.6 AND share <= 0.25 THEN false ELSE pred_r1 END AS pred_r2
  FROM r1 JOIN g2 USING (l_orderkey)),
r2c AS (SELECT *, CAST(pred_r2 <> pred_r1 AS INTEGER) AS r2_changed FROM r2),
ad AS (SELECT l_orderkey, avg(CAST(pred_r2 AS DOUBLE)) AS adult FROM r2c WHERE l_quantity > 18 GROUP BY l_orderkey),
r3 AS (SELECT r2c.*, CASE WHEN l_quantity < 5 AND gs > 1 AND adult IS NOT NULL AND adult > 0.7 AND NOT pred_r2 THEN true
  WHEN l_quantity < 5 AND gs > 1 AND adult IS NOT NULL AND adult < 0.3 AND pred_r2 THEN false ELSE pred_r2 END AS pred_r3
  FROM r2c LEFT JOIN ad USING (l_orderkey)),
r3c AS (SELECT *, CAST(pred_r3 <> pred_r2 AS INTEGER) AS r3_changed FROM r3)"""


def _r1(spark, sf):
    return R.rule_state(line_scored(spark, sf), "state", "spend", "prob", "pred0")


def _r2(spark, sf):
    return R.rule_group(_r1(spark, sf), "l_orderkey", "prob", "pred_r1")


def _r3(spark, sf):
    return R.rule_child(_r2(spark, sf), "l_orderkey", "l_quantity", "pred_r2")


@register("r1_rule_state", f"WITH {_LS} SELECT {LK}, pred_r1, r1_override FROM r1")
def r1_rule_state(spark, sf):
    return _r1(spark, sf).select(*LKEY, "pred_r1", "r1_override")


@register("r2_rule_group", f"WITH {_LS} SELECT {LK}, pred_r2, r2_changed FROM r2c")
def r2_rule_group(spark, sf):
    return _r2(spark, sf).select(*LKEY, "pred_r2", "r2_changed")


@register("r3_rule_child", f"WITH {_LS} SELECT {LK}, pred_r3, r3_changed FROM r3c")
def r3_rule_child(spark, sf):
    return _r3(spark, sf).select(*LKEY, "pred_r3", "r3_changed")


@register("r4_correction_counts", f"""WITH {_LS}
SELECT CAST(sum(r1_override) AS BIGINT) AS n_r1, CAST(sum(r2_changed) AS BIGINT) AS n_r2,
  CAST(sum(r3_changed) AS BIGINT) AS n_r3,
  count(*) FILTER (WHERE pred0 <> pred_r3) AS n_changed,
  round(count(*) FILTER (WHERE pred0 <> pred_r3) * 100.0 / count(*), 12) AS pct_changed FROM r3c""")
def r4_correction_counts(spark, sf):
    return R.correction_counts(_r3(spark, sf), "pred0", "pred_r3")
