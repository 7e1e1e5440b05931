"""Queries for binning (E*), grouped aggregation (F*) and group features (G*).

Rounding policy for oracle parity: only order-dependent floating aggregates
(avg/std/var/corr/median over doubles) are rounded (6 decimals; 9 for
correlations and probabilities, 2 for money sums); deterministic row-wise
arithmetic is compared unrounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions import rowwise as RW
from fitloom.operators import binning as E
from fitloom.operators import groupstats as G
from fitloom.operators.correlation import blocked_correlation
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import SPEND_COLS, basket, line, preds

LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LK = ", ".join(LKEY)
TOTAL = X.row_sum()


def basket_t(spark, sf):
    return basket(spark, sf).withColumn("total", RW.row_sum(SPEND_COLS))


# ---------------------------------------------------------------- E1-E4

AGE_EDGES = [-1000.0, 0.0, 2500.0, 5000.0, 7500.0, 10000.0]
AGE_LABELS = ["neg", "low", "mid", "high", "top"]
OPEN_EDGES = [-1000.0, 0.0, 5000.0, float("inf")]


@register("e1_cut_fixed", with_frames("basket", f"""
SELECT id, {X.cut_fixed('age', AGE_EDGES, AGE_LABELS)} AS age_band,
  {X.cut_fixed('age', AGE_EDGES, AGE_LABELS, include_lowest=True)} AS age_band_low,
  CAST({X.cut_fixed('age', OPEN_EDGES, None, include_lowest=True)} AS INTEGER) AS age_code_open
FROM basket"""))
def e1_cut_fixed(spark, sf):
    b = basket(spark, sf)
    return b.select("id", E.cut_fixed("age", AGE_EDGES, AGE_LABELS).alias("age_band"),
                    E.cut_fixed("age", AGE_EDGES, AGE_LABELS, include_lowest=True).alias("age_band_low"),
                    E.cut_fixed("age", OPEN_EDGES, None, include_lowest=True).alias("age_code_open"))


@register("e2_equal_width", with_frames("basket", """
mm AS (SELECT min(age) AS lo, max(age) AS hi FROM basket)
SELECT id, CAST(CASE WHEN age >= lo AND age <= hi THEN
  least(9, greatest(0, ceil((age - lo) / ((hi - lo) / 10)) - 1)) END AS INTEGER) AS age_bin10
FROM basket, mm"""))
def e2_equal_width(spark, sf):
    b = basket(spark, sf)
    lo, hi = E.fit_equal_width(b, "age")
    return b.select("id", E.cut_equal_width("age", lo, hi, 10).alias("age_bin10"))


def _qcut_sql(x, q, name):
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return (f"q_{name} AS (SELECT list_sort(list_distinct(quantile_cont({x}, [{probs}]))) AS e FROM b),\n"
            f"i_{name} AS (SELECT e, list_slice(e, 2, len(e) - 1) AS inner_e FROM q_{name})")


def _qcode_sql(x, name):
    return (f"CAST(CASE WHEN {x} >= e_{name}.e[1] AND {x} <= e_{name}.e[len(e_{name}.e)] THEN "
            f"len(list_filter(e_{name}.inner_e, lambda v: {x} > v)) END AS INTEGER)")


@register("e3_quantile_bins", with_frames("basket", f"""
b AS (SELECT id, {TOTAL} AS total, coalesce(sp_economy, 0.0) AS econ FROM basket),
{_qcut_sql('total', 20, 't')},
{_qcut_sql('econ', 4, 'x')}
SELECT id, {_qcode_sql('total', 't')} AS total_q20, {_qcode_sql('econ', 'x')} AS econ_q4
FROM b, i_t AS e_t, i_x AS e_x"""))
def e3_quantile_bins(spark, sf):
    b = basket(spark, sf).select("id", RW.row_sum(SPEND_COLS).alias("total"),
                                 F.coalesce("sp_economy", F.lit(0.0)).alias("econ"))
    et = E.fit_quantile_edges(b, "total", 20)
    ex = E.fit_quantile_edges(b, "econ", 4)
    return b.select("id", E.cut_by_edges("total", et).alias("total_q20"), E.cut_by_edges("econ", ex).alias("econ_q4"))


@register("e4_quantile_flags", with_frames("basket", f"""
b AS (SELECT id, age_n, {TOTAL} AS total FROM basket),
q AS (SELECT quantile_cont(total, 0.75) AS t75, quantile_cont(total, 0.25) AS t25,
             quantile_cont(age_n, 0.5) AS a50 FROM b)
SELECT id, CAST(coalesce(total > t75, false) AS INTEGER) AS big_spender,
  CAST(coalesce(total < t25, false) AS INTEGER) AS small_spender,
  CAST(coalesce(age_n > a50, false) AS INTEGER) * CAST(coalesce(total > t75, false) AS INTEGER) AS rich_big
FROM b, q"""))
def e4_quantile_flags(spark, sf):
    b = basket(spark, sf).select("id", "age_n", RW.row_sum(SPEND_COLS).alias("total"))
    qt = E.fit_quantiles(b, "total", [0.25, 0.75])
    qa = E.fit_quantiles(b, "age_n", [0.5])
    return b.select("id", E.above_quantile("total", qt[0.75]).alias("big_spender"),
                    E.below_quantile("total", qt[0.25]).alias("small_spender"),
                    (E.above_quantile("age_n", qa[0.5]) * E.above_quantile("total", qt[0.75])).alias("rich_big"))


# ---------------------------------------------------------------- F1-F10


@register("f1_group_agg", with_frames("basket", f"""
SELECT grp, coalesce(round(avg(age_n), 6), 0.0) AS age_n_mean, coalesce(round(stddev_samp(age_n), 6), 0.0) AS age_n_std,
  coalesce(round(min(age_n), 6), 0.0) AS age_n_min, coalesce(round(max(age_n), 6), 0.0) AS age_n_max,
  coalesce(round(sum({TOTAL}), 6), 0.0) AS total_sum, count({TOTAL}) AS total_count
FROM basket GROUP BY grp"""))
def f1_group_agg(spark, sf):
    b = basket_t(spark, sf)
    return G.group_agg(b, "grp", {"age_n": ["mean", "std", "min", "max"], "total": ["sum", "count"]}, decimals=6)


def _share_sql(denom):
    d = "count(*)" if denom == "all" else "count(planet_n)"
    return with_frames("basket", f"""
t AS (SELECT CAST({d} AS DOUBLE) AS d FROM basket)
SELECT planet_n, count(*) AS n, count(*) / max(t.d) AS share FROM basket, t
WHERE planet_n IS NOT NULL GROUP BY planet_n""")


@register("f2_value_share", _share_sql("all"))
def f2_value_share(spark, sf):
    return G.value_share(basket(spark, sf), "planet_n", "all")


@register("f2_value_share_nonnull", _share_sql("nonnull"))
def f2_value_share_nonnull(spark, sf):
    return G.value_share(basket(spark, sf), "planet_n", "nonnull")


@register("f3_distinct_counts", with_frames("basket", """
SELECT count(DISTINCT planet) AS planet_nunique, count(DISTINCT dest) AS dest_nunique,
       count(DISTINCT grp) AS grp_nunique, count(DISTINCT planet_n) AS planet_n_nunique FROM basket"""))
def f3_distinct_counts(spark, sf):
    return G.distinct_counts(basket(spark, sf), ["planet", "dest", "grp", "planet_n"])


@register("f4_label_rate", with_frames("basket", """
SELECT planet, avg(label) AS label_mean, count(*) AS n FROM basket GROUP BY planet"""))
def f4_label_rate(spark, sf):
    return G.label_rate(basket(spark, sf), "planet", "label")


@register("f5_filtered_median", with_frames("basket", f"""
SELECT planet, round(median(age), 6) AS age_median FROM basket WHERE {TOTAL} > 0 GROUP BY planet"""))
def f5_filtered_median(spark, sf):
    b = basket_t(spark, sf)
    out = G.filtered_median(b, F.col("total") > 0, "planet", "age")
    return out.select("planet", F.round("age_median", 6).alias("age_median"))


@register("f6_group_mode", """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS rn FROM c)
SELECT l_orderkey, l_returnflag AS l_returnflag_mode FROM r WHERE rn = 1""")
def f6_group_mode(spark, sf):
    return G.group_mode(line(spark, sf), "l_orderkey", "l_returnflag")


_VAR_COLS = ["age", *SPEND_COLS, "label"]


@register("f7_column_variance", with_frames("basket", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp(CAST({c} AS DOUBLE)), 2) AS variance FROM basket" for c in _VAR_COLS) + ")"))
def f7_column_variance(spark, sf):
    v = G.column_variance(basket(spark, sf), _VAR_COLS)
    return v.select("feature", F.round("variance", 2).alias("variance"))


_CORR_COLS = ["age", "sp_economy", "sp_large", "label"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


@register("f8_abs_correlation", with_frames("basket", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))), 9) AS abs_corr FROM basket"
    for a, b in _PAIRS)))
def f8_abs_correlation(spark, sf):
    c = G.abs_correlation(basket(spark, sf), _CORR_COLS)
    return c.select("feature_a", "feature_b", F.round("abs_corr", 9).alias("abs_corr"))


@register("f8_correlation_blocks", with_frames("basket", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))), 9) AS abs_corr FROM basket"
    for a, b in _PAIRS)))
def f8_correlation_blocks(spark, sf):
    c = blocked_correlation(basket(spark, sf), _CORR_COLS)
    return c.select("feature_a", "feature_b", F.round("abs_corr", 9).alias("abs_corr"))


@register("f9_prediction_distribution", with_frames("preds", """
SELECT member, count(*) FILTER (WHERE vote = 0) AS n_neg, count(*) FILTER (WHERE vote = 1) AS n_pos,
       avg(CAST(vote AS DOUBLE)) AS pos_rate FROM preds GROUP BY member"""))
def f9_prediction_distribution(spark, sf):
    return G.prediction_distribution(preds(spark, sf))


@register("f10_member_summary", with_frames("preds", """
SELECT row_id, round(avg(prob), 9) AS prob_mean, round(stddev_pop(prob), 9) AS prob_std,
       min(prob) AS prob_min, max(prob) AS prob_max FROM preds GROUP BY row_id"""))
def f10_member_summary(spark, sf):
    s = G.member_summary(preds(spark, sf))
    return s.select("row_id", F.round("prob_mean", 9).alias("prob_mean"), F.round("prob_std", 9).alias("prob_std"),
                    "prob_min", "prob_max")


# ---------------------------------------------------------------- G1-G10


@register("g1_group_size", f"""
WITH g AS (SELECT l_orderkey, count(*) AS g_size FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, g_size, CAST(g_size = 1 AS INTEGER) AS is_alone FROM lineitem JOIN g USING (l_orderkey)""")
def g1_group_size(spark, sf):
    li = G.group_size(line(spark, sf), "l_orderkey")
    return li.select(*LKEY, "g_size", (F.col("g_size") == 1).cast("int").alias("is_alone"))


@register("g2_group_stats", f"""
WITH g AS (SELECT l_orderkey, round(avg(l_extendedprice), 6) AS m, coalesce(round(stddev_samp(l_extendedprice), 6), 0.0) AS s,
  min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, round(avg(l_quantity), 6) AS qm, max(l_quantity) AS qx
  FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, m AS g_l_extendedprice_mean, s AS g_l_extendedprice_std, mn AS g_l_extendedprice_min,
  mx AS g_l_extendedprice_max, qm AS g_l_quantity_mean, qx AS g_l_quantity_max
FROM lineitem JOIN g USING (l_orderkey)""")
def g2_group_stats(spark, sf):
    li = G.attach_group_stats(line(spark, sf), "l_orderkey",
                              {"l_extendedprice": ["mean", "std", "min", "max"], "l_quantity": ["mean", "max"]})
    return li.select(*LKEY, F.round("g_l_extendedprice_mean", 6).alias("g_l_extendedprice_mean"),
                     F.round("g_l_extendedprice_std", 6).alias("g_l_extendedprice_std"),
                     "g_l_extendedprice_min", "g_l_extendedprice_max",
                     F.round("g_l_quantity_mean", 6).alias("g_l_quantity_mean"), "g_l_quantity_max")


@register("g3_group_avg_rank", f"""
SELECT {LK}, CAST(rank() OVER w AS DOUBLE) + (count(*) OVER (PARTITION BY l_orderkey, l_extendedprice) - 1) / 2.0
  AS l_extendedprice_grank
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice)""")
def g3_group_avg_rank(spark, sf):
    return G.group_avg_rank(line(spark, sf), "l_orderkey", "l_extendedprice").select(*LKEY, "l_extendedprice_grank")


@register("g4_group_deviation", f"""
WITH g AS (SELECT l_orderkey, avg(l_extendedprice) AS m, max(l_extendedprice) AS mx FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, round(l_extendedprice - m, 6) AS dev_mean, round(abs(l_extendedprice - m), 6) AS absdev_mean,
  l_extendedprice - mx AS dev_max FROM lineitem JOIN g USING (l_orderkey)""")
def g4_group_deviation(spark, sf):
    li = G.attach_group_stats(line(spark, sf), "l_orderkey", {"l_extendedprice": ["mean", "max"]})
    d = F.col("l_extendedprice") - F.col("g_l_extendedprice_mean")
    return li.select(*LKEY, F.round(d, 6).alias("dev_mean"), F.round(F.abs(d), 6).alias("absdev_mean"),
                     (F.col("l_extendedprice") - F.col("g_l_extendedprice_max")).alias("dev_max"))


@register("g5_group_extreme_flags", f"""
WITH g AS (SELECT l_orderkey, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, CAST(l_quantity = mx AS INTEGER) AS is_group_max, CAST(l_quantity = mn AS INTEGER) AS is_group_min
FROM lineitem JOIN g USING (l_orderkey)""")
def g5_group_extreme_flags(spark, sf):
    li = G.attach_group_stats(line(spark, sf), "l_orderkey", {"l_quantity": ["min", "max"]})
    return li.select(*LKEY, (F.col("l_quantity") == F.col("g_l_quantity_max")).cast("int").alias("is_group_max"),
                     (F.col("l_quantity") == F.col("g_l_quantity_min")).cast("int").alias("is_group_min"))


@register("g6_any_in_group", f"""
WITH g AS (SELECT l_orderkey, max(CAST(l_quantity > 45 AS INTEGER)) AS a FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, a AS any_big_line FROM lineitem JOIN g USING (l_orderkey)""")
def g6_any_in_group(spark, sf):
    li = line(spark, sf).withColumn("big", (F.col("l_quantity") > 45).cast("int"))
    li = G.attach_group_stats(li, "l_orderkey", {"big": ["max"]})
    return li.select(*LKEY, F.col("g_big_max").alias("any_big_line"))


@register("g7_group_consistency", f"""
WITH g AS (SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) = 1 AS INTEGER) AS c FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, c AS flag_consistent FROM lineitem JOIN g USING (l_orderkey)""")
def g7_group_consistency(spark, sf):
    li = G.attach_group_stats(line(spark, sf), "l_orderkey", {"l_returnflag": ["nunique1"]})
    return li.select(*LKEY, F.col("g_l_returnflag_nunique1").alias("flag_consistent"))


@register("g8_category_mean", with_frames("basket", """
c AS (SELECT planet_n, avg(age) AS m FROM basket WHERE planet_n IS NOT NULL GROUP BY planet_n),
gm AS (SELECT avg(age) AS g FROM basket)
SELECT id, round(coalesce(m, g), 6) AS age_by_planet_n, round(age - coalesce(m, g), 6) AS age_by_planet_n_dev
FROM basket LEFT JOIN c USING (planet_n), gm"""))
def g8_category_mean(spark, sf):
    b = G.category_mean(basket(spark, sf), "planet_n", "age")
    return b.select("id", F.round("age_by_planet_n", 6).alias("age_by_planet_n"),
                    F.round("age_by_planet_n_dev", 6).alias("age_by_planet_n_dev"))


@register("g9_group_median", f"""
WITH g AS (SELECT l_orderkey, round(median(l_extendedprice), 6) AS md FROM lineitem GROUP BY l_orderkey)
SELECT {LK}, md AS g_l_extendedprice_median FROM lineitem JOIN g USING (l_orderkey)""")
def g9_group_median(spark, sf):
    li = G.attach_group_stats(line(spark, sf), "l_orderkey", {"l_extendedprice": ["median"]})
    return li.select(*LKEY, F.round("g_l_extendedprice_median", 6).alias("g_l_extendedprice_median"))


@register("g10_category_volume", with_frames("basket", """
c AS (SELECT planet_n, count(*) AS planet_n_volume FROM basket WHERE planet_n IS NOT NULL GROUP BY planet_n)
SELECT id, planet_n_volume FROM basket LEFT JOIN c USING (planet_n)"""))
def g10_category_volume(spark, sf):
    return G.category_volume(basket(spark, sf), "planet_n").select("id", "planet_n_volume")
