"""Queries for encoders (J*), scalers (K*) and folds (N*): fit on split='train', apply to all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions import rowwise as RW
from fitloom.operators import encode as J
from fitloom.operators import folds as N
from fitloom.operators import group_folds as NG
from fitloom.operators.sparse_logistic import logistic_scores
from fitloom.operators.sparse_onehot import fit_sparse_one_hot
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import SPEND_COLS, basket

TR = "tr AS (SELECT * FROM basket WHERE split = 'train')"
MD5 = "md5(CAST(id AS VARCHAR))"


def split_frames(spark, sf):
    """basket persisted once: the fits read the training rows, the apply reads all rows."""
    from fitloom.session import keep_for_reuse

    b = keep_for_reuse(basket(spark, sf))
    return b, b.where(F.col("split") == "train")


# ---------------------------------------------------------------- J1-J8


@register("j1_frequency_encode", with_frames("basket", f"""
{TR},
f AS (SELECT grp, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM tr) AS freq FROM tr GROUP BY grp)
SELECT id, coalesce(freq, 0.0) AS grp_freq, coalesce(freq, 1.0 / (SELECT count(*) FROM tr)) AS grp_freq_floor,
       coalesce(freq, 0.001) AS grp_freq_floor001
FROM basket LEFT JOIN f USING (grp)"""))
def j1_frequency_encode(spark, sf):
    b, tr = split_frames(spark, sf)
    t, n = J.fit_frequency(tr, "grp")
    out = J.apply_lookup(b, t, "grp", "freq", "grp_freq", 0.0)
    return out.select("id", "grp_freq",
                      F.when(F.col("grp_freq") == 0.0, F.lit(1.0 / n)).otherwise(F.col("grp_freq")).alias("grp_freq_floor"),
                      F.when(F.col("grp_freq") == 0.0, F.lit(0.001)).otherwise(F.col("grp_freq")).alias("grp_freq_floor001"))


@register("j2_smoothed_target", with_frames("basket", f"""
{TR},
g AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM tr),
s AS (SELECT planet_n, (sum(CAST(label AS DOUBLE)) + 10.0 * max(g)) / (count(*) + 10.0) AS enc
      FROM tr, g WHERE planet_n IS NOT NULL GROUP BY planet_n)
SELECT id, round(coalesce(enc, g), 9) AS planet_te FROM basket LEFT JOIN s USING (planet_n), g"""))
def j2_smoothed_target(spark, sf):
    b, tr = split_frames(spark, sf)
    t, g = J.fit_smoothed_target(tr, "planet_n", "label", 10.0)
    out = J.apply_lookup(b, t.where(F.col("planet_n").isNotNull()), "planet_n", "enc", "planet_te", g)
    return out.select("id", F.round("planet_te", 9).alias("planet_te"))


def _oof_sql(col, fold_sql, m, out):
    enc = (f"((sa - sf) + {m} * g) / ((na - nf) + {m})" if m else "(sa - sf) / (na - nf)")
    full = f"(sa + {m} * g) / (na + {m})" if m else "sa / na"
    return with_frames("basket", f"""
tr AS (SELECT id, {col}, label, {fold_sql} AS fold FROM basket WHERE split = 'train'),
g AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM tr),
pf AS (SELECT {col}, fold, sum(CAST(label AS DOUBLE)) AS sf, count(*) AS nf FROM tr GROUP BY {col}, fold),
pa AS (SELECT {col}, sum(CAST(label AS DOUBLE)) AS sa, count(*) AS na FROM tr GROUP BY {col}),
enc AS (SELECT pf.{col}, fold, CASE WHEN na - nf > 0 THEN {enc} END AS e FROM pf JOIN pa USING ({col}), g
        WHERE pf.{col} IS NOT NULL),
fl AS (SELECT {col}, {full} AS e FROM pa, g WHERE {col} IS NOT NULL)
SELECT id, round(coalesce(enc.e, g), 9) AS {out} FROM tr LEFT JOIN enc USING ({col}, fold), g
UNION ALL
SELECT id, round(coalesce(fl.e, g), 9) AS {out} FROM basket LEFT JOIN fl USING ({col}), g WHERE split = 'test'""")


def _oof_query(spark, sf, col, folds_fn, m, out):
    b, tr = split_frames(spark, sf)
    tr = folds_fn(tr)
    g = J.global_mean(tr, "label")
    oof = J.oof_target_encode(tr, col, "label", "fold", out, smoothing=m, prior=g)
    stats = J.fit_target_stats(tr, col, "label").where(F.col(col).isNotNull())
    full = stats.select(col, (J.smoothed(F.col("sum_y"), F.col("n"), g, m) if m else
                              F.col("sum_y") / F.col("n")).alias("enc"))
    test = J.apply_lookup(b.where(F.col("split") == "test"), full, col, "enc", out, g)
    return oof.select("id", F.round(out, 9).alias(out)).unionByName(test.select("id", F.round(out, 9).alias(out)))


@register("j3_kfold_target_smoothed", _oof_sql("grp", f"(row_number() OVER (ORDER BY {MD5}) - 1) % 5", 10.0, "grp_te"))
def j3_kfold_target_smoothed(spark, sf):
    return _oof_query(spark, sf, "grp", lambda d: N.kfold(d, "id", 5), 10.0, "grp_te")


@register("j4_kfold_target_mean", _oof_sql(
    "planet_n", f"(row_number() OVER (PARTITION BY label ORDER BY {MD5}) - 1) % 5", 0.0, "planet_te"))
def j4_kfold_target_mean(spark, sf):
    return _oof_query(spark, sf, "planet_n", lambda d: N.stratified_kfold(d, "id", "label", 5), 0.0, "planet_te")


@register("j5_target_mean_count", with_frames("basket", f"""
{TR},
s AS (SELECT coalesce(planet_n, 'nan') AS k, avg(CAST(label AS DOUBLE)) AS m, count(*) AS n FROM tr GROUP BY 1)
SELECT id, round(coalesce(m, 0.5), 9) AS planet_target_mean, coalesce(n, 1) AS planet_target_count
FROM basket LEFT JOIN s ON coalesce(planet_n, 'nan') = k"""))
def j5_target_mean_count(spark, sf):
    b, tr = split_frames(spark, sf)
    st = J.fit_target_stats(tr, "planet_n", "label", nan_as_category=True)
    b = b.withColumn("__k", J.category_key("planet_n", True))
    st = st.withColumnRenamed("planet_n", "__k")
    out = J.apply_lookup(b, st, "__k", "mean_y", "planet_target_mean", 0.5)
    out = J.apply_lookup(out, st, "__k", "n", "planet_target_count", 1)
    return out.select("id", F.round("planet_target_mean", 9).alias("planet_target_mean"),
                      F.col("planet_target_count").cast("long").alias("planet_target_count"))


@register("j6_sigmoid_target", with_frames("basket", f"""
{TR},
g AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM tr),
s AS (SELECT grp, count(*) AS n, avg(CAST(label AS DOUBLE)) AS m FROM tr GROUP BY grp),
e AS (SELECT grp, g * (1 - 1.0 / (1.0 + exp(-(n - 5) / 0.3))) + m * (1.0 / (1.0 + exp(-(n - 5) / 0.3))) AS enc FROM s, g)
SELECT id, round(coalesce(enc, g), 9) AS grp_sigmoid_te FROM basket LEFT JOIN e USING (grp), g"""))
def j6_sigmoid_target(spark, sf):
    b, tr = split_frames(spark, sf)
    t, g = J.fit_sigmoid_target(tr, "grp", "label", smoothing=0.3, min_samples_leaf=5)
    out = J.apply_lookup(b, t, "grp", "enc", "grp_sigmoid_te", g)
    return out.select("id", F.round("grp_sigmoid_te", 9).alias("grp_sigmoid_te"))


@register("j6_sigmoid_target_oof", with_frames("basket", f"""
tr AS (SELECT id, grp, label, (row_number() OVER (ORDER BY {MD5}) - 1) % 5 AS fold FROM basket WHERE split = 'train'),
p AS (SELECT f.fold, avg(CAST(t.label AS DOUBLE)) AS prior FROM (SELECT DISTINCT fold FROM tr) f JOIN tr t ON t.fold <> f.fold GROUP BY 1),
pf AS (SELECT grp, fold, sum(CAST(label AS DOUBLE)) AS sf, count(*) AS nf FROM tr GROUP BY grp, fold),
pa AS (SELECT grp, sum(CAST(label AS DOUBLE)) AS sa, count(*) AS na FROM tr GROUP BY grp),
e AS (SELECT grp, fold, CASE WHEN na > nf THEN (sa - sf) / (na - nf) END AS m,
  CASE WHEN na > nf THEN 1.0 / (1.0 + exp(-(na - nf - 3) / 0.3)) ELSE 0.0 END AS w FROM pf JOIN pa USING (grp))
SELECT id, round(prior * (1 - coalesce(w, 0.0)) + coalesce(m, 0.0) * coalesce(w, 0.0), 9) AS grp_sigmoid_te
FROM tr JOIN p USING (fold) LEFT JOIN e USING (grp, fold)"""))
def j6_sigmoid_target_oof(spark, sf):
    _, tr = split_frames(spark, sf)
    out = J.oof_sigmoid_target(N.kfold(tr, "id", 5), "grp", "label", "fold", "te", smoothing=0.3, min_samples_leaf=3)
    return out.select("id", F.round("te", 9).alias("grp_sigmoid_te"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("j7_one_hot", with_frames("basket", "SELECT id, " + ", ".join(
    f"CAST(coalesce(planet_n = '{v}', false) AS INTEGER) AS planet_n_{v}" for v in _SEGMENTS[1:]) + " FROM basket"))
def j7_one_hot(spark, sf):
    b, tr = split_frames(spark, sf)
    cats = J.fit_categories(tr, "planet_n")
    return J.one_hot(b, "planet_n", cats).select("id", *[f"planet_n_{v}" for v in cats[1:]])


# planet_n, then one place per customer but the first: as many as the table has
@register("j7_sparse_one_hot", with_frames("basket", f"""
{TR},
pc AS (SELECT planet_n, dense_rank() OVER (ORDER BY planet_n) - 1 AS code FROM (SELECT DISTINCT planet_n FROM tr WHERE planet_n IS NOT NULL)),
gc AS (SELECT grp, dense_rank() OVER (ORDER BY grp) - 1 AS code FROM (SELECT DISTINCT grp FROM tr)),
z AS (SELECT greatest((SELECT count(*) FROM pc) - 1, 0) AS np, greatest((SELECT count(*) FROM gc) - 1, 0) AS ng)
SELECT id, CAST(1 + np + ng AS INTEGER) AS width, coalesce(age, 0.0) AS age,
  CAST(CASE WHEN pc.code > 0 THEN pc.code END AS INTEGER) AS planet_place,
  CAST(CASE WHEN gc.code > 0 THEN np + gc.code END AS INTEGER) AS grp_place
FROM basket LEFT JOIN pc USING (planet_n) LEFT JOIN gc USING (grp) CROSS JOIN z"""))
def j7_sparse_one_hot(spark, sf):
    b, tr = split_frames(spark, sf)
    fitted = fit_sparse_one_hot(tr, ["planet_n", "grp"], ["age"])
    _, first, n = fitted.tables["planet_n"]
    hot = fitted.indexed(b)

    def place(lo, hi):
        return F.get(F.filter("indices", lambda i: (i >= lo) & (i < hi)), 0)

    return hot.select("id", F.lit(fitted.width).alias("width"), F.get("values", 0).alias("age"),
                      place(first, first + n).alias("planet_place"), place(first + n, fitted.width).alias("grp_place"))


@register("j7_sparse_logistic")
def j7_sparse_logistic(spark, sf):
    b, tr = split_frames(spark, sf)
    fitted = fit_sparse_one_hot(tr, ["planet_n", "grp"], ["age"])
    out = logistic_scores(fitted, tr, b.where("split = 'test'"), ["id"], max_iter=20, reg=0.01)
    return out.select("id", F.round("prob", 9).alias("prob"))


@register("j8_ordinal_codes", with_frames("basket", f"""
{TR},
pc AS (SELECT planet_n, CAST(dense_rank() OVER (ORDER BY planet_n) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT planet_n FROM basket WHERE planet_n IS NOT NULL)),
dc AS (SELECT dest, CAST(dense_rank() OVER (ORDER BY dest) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT dest FROM tr WHERE dest IS NOT NULL))
SELECT id, coalesce(pc.code, -1) AS planet_code, coalesce(dc.code, -1) AS dest_code
FROM basket LEFT JOIN pc USING (planet_n) LEFT JOIN dc USING (dest)"""))
def j8_ordinal_codes(spark, sf):
    b, tr = split_frames(spark, sf)
    out = J.apply_ordinal(b, J.fit_ordinal(b, "planet_n"), "planet_n", "planet_code")
    out = J.apply_ordinal(out, J.fit_ordinal(tr, "dest"), "dest", "dest_code")
    return out.select("id", "planet_code", "dest_code")


# ---------------------------------------------------------------- K1-K2

_TOT = X.row_sum()


@register("k1_standardize", with_frames("basket", f"""
b AS (SELECT id, split, age, {_TOT} AS total FROM basket),
s AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(total) AS mt, stddev_pop(total) AS st FROM b WHERE split = 'train')
SELECT id, round((age - ma) / CASE WHEN sa = 0 THEN 1.0 ELSE sa END, 9) AS age_z,
       round((total - mt) / CASE WHEN st = 0 THEN 1.0 ELSE st END, 9) AS total_z FROM b, s"""))
def k1_standardize(spark, sf):
    b = basket(spark, sf).select("id", "split", "age", RW.row_sum(SPEND_COLS).alias("total"))
    params = J.fit_standard(b.where(F.col("split") == "train"), ["age", "total"])
    out = J.apply_scale(b, params)
    return out.select("id", F.round("age_z", 9).alias("age_z"), F.round("total_z", 9).alias("total_z"))


@register("k2_robust_scale", with_frames("basket", f"""
b AS (SELECT id, split, age, {_TOT} AS total FROM basket),
s AS (SELECT quantile_cont(age, [0.25, 0.5, 0.75]) AS qa, quantile_cont(total, [0.25, 0.5, 0.75]) AS qt
      FROM b WHERE split = 'train')
SELECT id, round((age - qa[2]) / CASE WHEN qa[3] - qa[1] = 0 THEN 1.0 ELSE qa[3] - qa[1] END, 9) AS age_r,
       round((total - qt[2]) / CASE WHEN qt[3] - qt[1] = 0 THEN 1.0 ELSE qt[3] - qt[1] END, 9) AS total_r FROM b, s"""))
def k2_robust_scale(spark, sf):
    b = basket(spark, sf).select("id", "split", "age", RW.row_sum(SPEND_COLS).alias("total"))
    params = J.fit_robust(b.where(F.col("split") == "train"), ["age", "total"])
    out = J.apply_scale(b, params, suffix="_r")
    return out.select("id", F.round("age_r", 9).alias("age_r"), F.round("total_r", 9).alias("total_r"))


# ---------------------------------------------------------------- N1-N5


@register("n1_stratified_holdout", with_frames("basket", f"""
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {MD5}) - 1) * 1000
  < count(*) OVER (PARTITION BY label) * 200 AS INTEGER) AS holdout FROM basket"""))
def n1_stratified_holdout(spark, sf):
    return N.stratified_holdout(basket(spark, sf).select("id", "label"), "id", "label", 200)


@register("n2_stratified_kfold", with_frames("basket", f"""
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {MD5}) - 1) % 5 AS INTEGER) AS fold FROM basket"""))
def n2_stratified_kfold(spark, sf):
    return N.stratified_kfold(basket(spark, sf).select("id", "label"), "id", "label", 5)


@register("n3_stratified_group_kfold", with_frames("basket", """
g AS (SELECT grp, count(*) AS n, sum(label) AS p FROM basket GROUP BY grp),
o AS (SELECT grp, row_number() OVER (ORDER BY p / n, n, md5(CAST(grp AS VARCHAR))) - 1 AS pos FROM g),
f AS (SELECT grp, CAST(CASE WHEN floor(pos / 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM o)
SELECT id, grp, fold FROM basket JOIN f USING (grp)"""))
def n3_stratified_group_kfold(spark, sf):
    b = basket(spark, sf).select("id", "grp", "label")
    out = N.stratified_group_kfold(b, "grp", "label", 5)
    return out.select("id", "grp", "fold")


# One group after the other, each to the fold where it adds least to the variance of the class shares.
@register("n3_balanced_group_kfold", "WITH RECURSIVE " + with_frames("basket", """
g AS (SELECT grp, sum(label) AS p, count(*) - sum(label) AS n FROM basket GROUP BY grp),
o AS (SELECT *, row_number() OVER (ORDER BY abs(p - n) DESC, p + n DESC, p DESC, md5(CAST(grp AS VARCHAR))) AS i,
    row_number() OVER (PARTITION BY p, n ORDER BY md5(CAST(grp AS VARCHAR))) AS place,
    p / (sum(p) OVER ()::DOUBLE * sum(p) OVER ()::DOUBLE) AS bp, n / (sum(n) OVER ()::DOUBLE * sum(n) OVER ()::DOUBLE) AS bn FROM g),
r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS x, [0, 0, 0, 0, 0]::BIGINT[] AS y, 0::BIGINT AS p, 0::BIGINT AS n, 0::BIGINT AS f
  UNION ALL
  SELECT i, list_transform(x, lambda v, k: v + CASE WHEN k = f THEN p ELSE 0 END), list_transform(y, lambda v, k: v + CASE WHEN k = f THEN n ELSE 0 END), p, n, f
  FROM (SELECT o.i, r.x, r.y, o.p::BIGINT AS p, o.n::BIGINT AS n, list_min(list_transform([1, 2, 3, 4, 5], lambda k:
      {'a': r.x[k] * o.bp + r.y[k] * o.bn, 'b': r.x[k] + r.y[k], 'k': k})).k::BIGINT AS f FROM r JOIN o ON o.i = r.i + 1)),
c AS (SELECT p, n, f, count(*) AS m FROM r WHERE i > 0 GROUP BY p, n, f),
u AS (SELECT p, n, f, sum(m) OVER (PARTITION BY p, n ORDER BY f) AS upto FROM c),
t AS (SELECT grp, (SELECT min(u.f) - 1 FROM u WHERE u.p = o.p AND u.n = o.n AND u.upto >= o.place) AS fold FROM o)
SELECT id, grp, CAST(fold AS INTEGER) AS fold FROM basket JOIN t USING (grp)""").removeprefix("WITH "))
def n3_balanced_group_kfold(spark, sf):
    out = NG.balanced_group_kfold(spark, basket(spark, sf).select("id", "grp", "label"), "grp", "label", 5)
    return out.select("id", "grp", "fold")


@register("n4_repeated_stratified", with_frames("basket", """
r AS (SELECT id, label, CAST(t.r AS INTEGER) AS repeat, md5(CAST(id AS VARCHAR) || '#' || CAST(t.r AS VARCHAR)) AS h
      FROM basket CROSS JOIN range(3) t(r))
SELECT id, repeat, CAST((row_number() OVER (PARTITION BY repeat, label ORDER BY h) - 1) % 5 AS INTEGER) AS fold FROM r"""))
def n4_repeated_stratified(spark, sf):
    out = N.repeated_stratified_kfold(basket(spark, sf).select("id", "label"), "id", "label", 5, 3)
    return out.select("id", "repeat", "fold")


@register("n5_kfold", with_frames("basket", f"""
SELECT id, CAST((row_number() OVER (ORDER BY {MD5}) - 1) % 5 AS INTEGER) AS fold FROM basket"""))
def n5_kfold(spark, sf):
    return N.kfold(basket(spark, sf).select("id"), "id", 5)
