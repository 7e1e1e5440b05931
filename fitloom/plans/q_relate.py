"""Queries for joins (H*), set operations (I*) and top-k (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions import parse as P
from fitloom.functions import rowwise as RW
from fitloom.operators import encode as J
from fitloom.operators import ensemble as EN
from fitloom.operators import groupstats as G
from fitloom.operators import relate as H
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import SPEND_COLS, basket, preds

TOTAL = X.row_sum()


@register("h1_join_group_stats", with_frames("basket", f"""
s AS (SELECT grp, coalesce(round(avg(age_n), 6), 0.0) AS age_n_mean, coalesce(round(sum({TOTAL}), 6), 0.0) AS total_sum
      FROM basket GROUP BY grp)
SELECT id, age_n_mean, total_sum FROM basket LEFT JOIN s USING (grp)"""))
def h1_join_group_stats(spark, sf):
    b = basket(spark, sf).withColumn("total", RW.row_sum(SPEND_COLS))
    stats = G.group_agg(b, "grp", {"age_n": ["mean"], "total": ["sum"]}, decimals=6)
    return H.attach(b, stats, "grp").select("id", "age_n_mean", "total_sum")


@register("h2_lookup_default", with_frames("basket", """
tr AS (SELECT * FROM basket WHERE split = 'train'),
g AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM tr),
s AS (SELECT grp, avg(CAST(label AS DOUBLE)) AS r FROM tr GROUP BY grp)
SELECT id, round(coalesce(r, g), 9) AS grp_rate FROM basket LEFT JOIN s USING (grp), g"""))
def h2_lookup_default(spark, sf):
    b = basket(spark, sf)
    tr = b.where(F.col("split") == "train")
    stats = J.fit_target_stats(tr, "grp", "label")
    out = H.lookup_with_default(b, stats, "grp", "mean_y", "grp_rate", J.global_mean(tr, "label"))
    return out.select("id", F.round("grp_rate", 9).alias("grp_rate"))


_MISSING = [*SPEND_COLS, "state_n", "age_n", "planet_n"]


@register("h3_hconcat", with_frames("basket", f"""
SELECT id, {TOTAL} AS total, {' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _MISSING)} AS n_missing FROM basket"""))
def h3_hconcat(spark, sf):
    b = basket(spark, sf)
    a = b.select("id", RW.row_sum(SPEND_COLS).alias("total"))
    c = b.select("id", P.missing_count(_MISSING).alias("n_missing"))
    return H.hconcat([a, c], "id")


@register("h4_align_columns", with_frames("basket", """
SELECT id, CAST(coalesce(planet_n = 'BUILDING', false) AS INTEGER) AS planet_n_BUILDING,
  CAST(coalesce(planet_n = 'FURNITURE', false) AS INTEGER) AS planet_n_FURNITURE,
  CAST(coalesce(planet_n = 'HOUSEHOLD', false) AS INTEGER) AS planet_n_HOUSEHOLD,
  CAST(coalesce(planet_n = 'MACHINERY', false) AS INTEGER) AS planet_n_MACHINERY,
  0 AS train_only_feature
FROM basket WHERE split = 'test'"""))
def h4_align_columns(spark, sf):
    b = basket(spark, sf)
    tr, te = b.where(F.col("split") == "train"), b.where(F.col("split") == "test")
    train_cols = ["id"] + [f"planet_n_{v}" for v in J.fit_categories(tr, "planet_n")[1:]] + ["train_only_feature"]
    test_x = J.one_hot(te, "planet_n", J.fit_categories(te, "planet_n"), drop_first=False)
    return H.align_columns(test_x, train_cols, 0)


@register("h5_compare_predictions", with_frames("preds", """
SELECT count(*) FILTER (WHERE a.vote IS DISTINCT FROM b.vote) AS n_diff, count(*) AS n_rows
FROM (SELECT row_id, vote FROM preds WHERE member = 0) a JOIN (SELECT row_id, vote FROM preds WHERE member = 1) b USING (row_id)"""))
def h5_compare_predictions(spark, sf):
    p = preds(spark, sf)
    return H.compare_predictions(p.where("member = 0"), p.where("member = 1"), "row_id", "vote")


@register("i1_union_provenance", with_frames("basket", """
SELECT id, age, label, 'train' AS split FROM basket WHERE split = 'train'
UNION ALL SELECT id, age, NULL AS label, 'test' AS split FROM basket WHERE split = 'test'"""))
def i1_union_provenance(spark, sf):
    b = basket(spark, sf)
    tr = b.where(F.col("split") == "train").select("id", "age", "label")
    te = b.where(F.col("split") == "test").select("id", "age")
    u = H.union_with_provenance(tr, te)
    a, c = H.split_back(u)
    assert set(c.columns) == {"id", "age", "label"} and "split" not in a.columns
    return u.select("id", "age", "label", "split")


@register("i2_pseudo_label_union", with_frames("basket preds", """
SELECT id, label, 0 AS is_pseudo FROM basket WHERE split = 'train'
UNION ALL
SELECT id, CAST(prob >= 0.9 AS INTEGER) AS label, 1 AS is_pseudo
FROM basket JOIN preds ON id = row_id AND member = 0 WHERE split = 'test' AND (prob >= 0.9 OR prob <= 0.1)"""))
def i2_pseudo_label_union(spark, sf):
    b = basket(spark, sf)
    p = preds(spark, sf).where("member = 0").select(F.col("row_id").alias("id"), "prob")
    labelled = b.where(F.col("split") == "train").select("id", "label")
    scored = b.where(F.col("split") == "test").select("id").join(p, "id")
    return H.add_pseudo_labels(labelled, scored, "prob", "label", 0.9, 0.1).select("id", "label", "is_pseudo")


@register("i3_category_union", with_frames("basket", """
SELECT DISTINCT planet_n FROM (SELECT planet_n FROM basket WHERE split = 'train'
  UNION ALL SELECT planet_n FROM basket WHERE split = 'test') WHERE planet_n IS NOT NULL"""))
def i3_category_union(spark, sf):
    b = basket(spark, sf)
    return H.category_union(b.where(F.col("split") == "train"), b.where(F.col("split") == "test"), "planet_n")


_VAR_COLS = ["age", *SPEND_COLS, "label"]


@register("t1_top_n", with_frames("basket", """
v AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp(CAST({c} AS DOUBLE)), 2) AS variance FROM basket" for c in _VAR_COLS) + """)
SELECT feature, variance FROM v ORDER BY variance DESC, feature LIMIT 3"""))
def t1_top_n(spark, sf):
    v = G.column_variance(basket(spark, sf), _VAR_COLS).select("feature", F.round("variance", 2).alias("variance"))
    return H.top_n(v, "variance", 3, "feature")


@register("t2_drop_list", with_frames("basket", """
m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS DOUBLE)), 12) AS missing_share FROM basket" for c in _MISSING) + """)
SELECT feature FROM m ORDER BY missing_share DESC, feature LIMIT 2"""))
def t2_drop_list(spark, sf):
    b = basket(spark, sf)
    wide = b.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 12).alias(c) for c in _MISSING])
    stack = ", ".join(f"'{c}', `{c}`" for c in _MISSING)
    long = wide.selectExpr(f"stack({len(_MISSING)}, {stack}) as (feature, missing_share)")
    names = H.top_n_names(long, "feature", "missing_share", 2)
    return spark.createDataFrame([(n,) for n in names], "feature string") if names else long.select("feature").limit(0)


@register("t3_keep_closest_members", with_frames("preds", """
c AS (SELECT row_id, avg(CAST(vote AS DOUBLE)) AS c FROM preds GROUP BY row_id),
d AS (SELECT member, round(avg(abs(vote - c)), 12) AS deviation FROM preds JOIN c USING (row_id) GROUP BY member)
SELECT member, deviation FROM d ORDER BY deviation, member LIMIT 3"""))
def t3_keep_closest_members(spark, sf):
    return H.keep_smallest(EN.member_deviation(preds(spark, sf)), "deviation", 3, "member")
