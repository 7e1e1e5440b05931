"""Queries for clustering (L*) and feature selection by statistics (M1, M2, M4, M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions import rowwise as RW
from fitloom.operators import cluster as L
from fitloom.operators import kmeans_runs as KR
from fitloom.operators import select as M
from fitloom.operators.neighbours import neighbour_information
from fitloom.operators.silhouette import best_number_of_clusters, silhouettes
from fitloom.operators.ward import fit_ward
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.session import keep_for_reuse
from fitloom.sources.frames import SPEND_COLS, basket

TOTAL = X.row_sum()


def basket_feats(spark, sf):
    b = basket(spark, sf).withColumn("total", RW.row_sum(SPEND_COLS))
    return b, b.where(F.col("split") == "train")


@register("l1_kmeans")
def l1_kmeans(spark, sf):
    b, tr = basket_feats(spark, sf)
    return L.kmeans_label(tr, b, ["age", "total"], 5).select("id", "cluster")


@register("l1_kmeans_restarts")
def l1_kmeans_restarts(spark, sf):
    b, tr = basket_feats(spark, sf)
    return KR.fit_runs(tr, {"cluster": (["age", "total"], 5)}, restarts=10).label(b).select("id", "cluster")


@register("l3_multi_k_restarts")
def l3_multi_k_restarts(spark, sf):
    b, tr = basket_feats(spark, sf)
    views = {f"km{k}": (["age", "total"], k) for k in (5, 8, 12)}
    return KR.fit_runs(tr, views, restarts=10).label(b).select("id", *views)


# Three literal centres over (age, total spend).
CENTRES = [(0.0, 0.0), (5000.0, 100000.0), (8000.0, 400000.0)]


def _centre_sql():
    ds = [f"((age - {a!r}) * (age - {a!r}) + (total - {t!r}) * (total - {t!r}))" for a, t in CENTRES]
    best = f"least({', '.join(ds)})"
    return f"CASE WHEN {ds[0]} = {best} THEN 0 WHEN {ds[1]} = {best} THEN 1 ELSE 2 END"


@register("l2_nearest_centroid", with_frames("basket", f"""
b AS (SELECT id, age, {TOTAL} AS total FROM basket)
SELECT id, {_centre_sql()} AS cluster FROM b"""))
def l2_nearest_centroid(spark, sf):
    b, _ = basket_feats(spark, sf)
    return b.select("id", L.nearest_centroid(["age", "total"], CENTRES).alias("cluster"))


@register("l3_multi_k")
def l3_multi_k(spark, sf):
    b, _ = basket_feats(spark, sf)
    b = keep_for_reuse(b.select("id", "split", "age", "total"))       # six fits and the labels read it
    return L.multi_k(b.where(F.col("split") == "train"), b, ["age", "total"], [5, 8, 12]).select("id", "km5", "km8", "km12")


@register("l4_multiview_clusters")
def l4_multiview_clusters(spark, sf):
    b, _ = basket_feats(spark, sf)
    b = b.withColumn("econ", F.coalesce("sp_economy", F.lit(0.0))).withColumn("large", F.coalesce("sp_large", F.lit(0.0)))
    b = keep_for_reuse(b.select("id", "split", "age", "grp", "total", "econ", "large"))     # six fits and the labels read it
    tr = b.where(F.col("split") == "train")
    views = [("demo", ["age"], 8), ("behavior", ["total", "econ", "large"], 10), ("location", ["grp"], 6)]
    return L.multiview(tr, b, views).select("id", "cl_demo", "cl_behavior", "cl_location")


@register("l4_multiview_restarts")
def l4_multiview_restarts(spark, sf):
    b, _ = basket_feats(spark, sf)
    b = b.withColumn("econ", F.coalesce("sp_economy", F.lit(0.0))).withColumn("large", F.coalesce("sp_large", F.lit(0.0)))
    views = {"cl_demo": (["age"], 8), "cl_behavior": (["total", "econ", "large"], 10), "cl_location": (["grp"], 6)}
    runs = KR.fit_runs(b.where(F.col("split") == "train"), views, restarts=10, scaling="robust")
    return runs.label(b).select("id", *views)


@register("l5_ward_segments")
def l5_ward_segments(spark, sf):
    b, tr = basket_feats(spark, sf)
    return fit_ward(spark, tr, ["age", "total"], 12).label(b).select("id", "segment")


@register("l5_bisecting_segments")
def l5_bisecting_segments(spark, sf):
    b, tr = basket_feats(spark, sf)
    return L.bisecting_label(tr, b, ["age", "total"], 12).select("id", "cl_hier")


@register("l6_silhouette_k")
def l6_silhouette_k(spark, sf):
    b, _ = basket_feats(spark, sf)
    return L.silhouette_scan(spark, b, ["age", "total"], list(range(3, 11)))


@register("l6_best_k_euclidean")
def l6_best_k_euclidean(spark, sf):
    _, tr = basket_feats(spark, sf)
    return best_number_of_clusters(tr, ["age", "total"], list(range(3, 11)), "id", restarts=3)


def _near_sql(centres):
    ds = [f"((age - {a!r}) * (age - {a!r}) + (total - {t!r}) * (total - {t!r}))" for a, t in centres]
    return "CASE " + " ".join(f"WHEN {d} = least({', '.join(ds)}) THEN {i}" for i, d in enumerate(ds)) + " END"


def _silhouette_sql(label):
    return f"""SELECT '{label}' AS clustering, round(sum(n * CASE WHEN others > 0 AND b IS NOT NULL AND greatest(a, b) > 0
  THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(n), 6) AS silhouette, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT h, any_value(n) AS n, sum(w - inside) FILTER (own = c) AS others, min(sd / w) FILTER (own <> c) AS b,
    sum(CASE WHEN w > inside THEN sd / (w - inside) END) FILTER (own = c) AS a FROM (
      SELECT p.h, any_value(p.n) AS n, any_value(p.{label}) AS own, s.{label} AS c, sum(s.n) AS w, max(CAST(p.h = s.h AS INTEGER)) AS inside,
        sum(s.n * sqrt((p.age - s.age) * (p.age - s.age) + (p.total - s.total) * (p.total - s.total))) AS sd
      FROM p CROSS JOIN s GROUP BY p.h, s.{label}) GROUP BY h)"""


@register("l6_silhouette_euclidean", with_frames("basket", f"""
b AS (SELECT id, age, {TOTAL} AS total FROM basket),
p AS (SELECT age, total, {_near_sql(CENTRES[:2])} AS two, {_near_sql(CENTRES)} AS three, count(*) AS n, min(md5(CAST(id AS VARCHAR))) AS h
  FROM b WHERE age IS NOT NULL AND total IS NOT NULL GROUP BY ALL),
s AS (SELECT * FROM p ORDER BY h LIMIT 2000)
{_silhouette_sql("two")} UNION ALL {_silhouette_sql("three")}"""))
def l6_silhouette_euclidean(spark, sf):
    b, _ = basket_feats(spark, sf)
    b = b.withColumn("two", L.nearest_centroid(["age", "total"], CENTRES[:2])).withColumn("three", L.nearest_centroid(["age", "total"], CENTRES))
    return silhouettes(b, ["age", "total"], ["two", "three"], "id").withColumn("silhouette", F.round("silhouette", 6))


_M1_COLS = ["age", "age_n", "sp_economy", "label", "grp"]


@register("m1_zero_variance", with_frames("basket", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp(CAST({c} AS DOUBLE)), 2) AS variance, "
    f"CAST(coalesce(var_samp(CAST({c} AS DOUBLE)), 0.0) > 0 AS INTEGER) AS keep FROM basket" for c in _M1_COLS)))
def m1_zero_variance(spark, sf):
    z = M.zero_variance(basket(spark, sf), _M1_COLS)
    return z.select("feature", F.round("variance", 2).alias("variance"), "keep")


_M2_COLS = ["age", "age_n", "sp_economy", "sp_large", "label"]


def _m2_sql():
    pairs = [(a, b) for i, a in enumerate(_M2_COLS) for b in _M2_COLS[i + 1:]]
    corr = ", ".join(f"abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS c_{a}_{b}" for a, b in pairs)
    rows = []
    for j, c in enumerate(_M2_COLS):
        conds = [f"coalesce(c_{a}_{c} > 0.95, false)" for a in _M2_COLS[:j]]
        rows.append(f"SELECT '{c}' AS feature, CAST({' OR '.join(conds) if conds else 'false'} AS INTEGER) AS dropped FROM cc")
    return with_frames("basket", f"cc AS (SELECT {corr} FROM basket)\n" + " UNION ALL ".join(rows))


@register("m2_correlation_filter", _m2_sql())
def m2_correlation_filter(spark, sf):
    return M.correlation_filter(spark, basket(spark, sf), _M2_COLS, 0.95)


def _mi_sql(cols, q):
    parts = []
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, round(sum((n / nt) * ln((n * nt) / (nb * ny))), 9) AS mi FROM (
  SELECT n, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY label) AS ny, sum(n) OVER () AS nt FROM (
    SELECT bin, label, CAST(count(*) AS DOUBLE) AS n FROM (
      SELECT CASE WHEN {c} >= e[1] AND {c} <= e[len(e)] THEN len(list_filter(list_slice(e, 2, len(e) - 1), lambda v: {c} > v)) END AS bin,
             label FROM b, (SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS e FROM b))
    WHERE bin IS NOT NULL GROUP BY bin, label))""")
    return " UNION ALL ".join(parts)


_M4_COLS = ["age", "total"]


@register("m4_mutual_information", with_frames("basket", f"""
b AS (SELECT id, age, {TOTAL} AS total, label FROM basket),
s AS ({_mi_sql(_M4_COLS, 10)})
SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) <= 1 AS INTEGER) AS selected FROM s"""))
def m4_mutual_information(spark, sf):
    b, _ = basket_feats(spark, sf)
    mi = M.mutual_information(b, _M4_COLS, "label", 10)
    return M.top_k_flag(mi, "mi", 1)


def _psi(n):
    t = f"({n} + 6.0::DOUBLE)"
    series = (f"ln({t}) - 1 / (2 * {t}) - 1 / (12 * {t} ** 2) + 1 / (120 * {t} ** 4) - 1 / (252 * {t} ** 6) + 1 / (240 * {t} ** 8)")
    return f"({series} - {' - '.join(f'1 / ({n} + {i}.0::DOUBLE)' for i in range(6))})"


def _neighbour_sql(cols, k):
    union = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, label AS y FROM b WHERE {c} IS NOT NULL" for c in cols)
    sides = ", ".join(f"lag(x, {j}) OVER w AS l{j}, lead(x, {j}) OVER w AS h{j}" for j in range(1, k + 1))
    inf = "'inf'::DOUBLE"

    def radius(j):
        left = [f"coalesce(x - l{i}, {inf})" if i else "0.0" for i in range(j + 1)]
        right = [f"coalesce(h{j - i} - x, {inf})" if j - i else "0.0" for i in range(j + 1)]
        return "least(" + ", ".join(f"greatest({a}, {c})" for a, c in zip(left, right, strict=True)) + ")"

    near = "CASE " + " ".join(f"WHEN ny - 1 = {j} THEN {radius(j)}" for j in range(1, k)) + f" ELSE {radius(k)} END"
    return f"""u AS ({union}),
d AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny FROM u) WHERE ny > 1),
w AS (SELECT *, {sides} FROM d WINDOW w AS (PARTITION BY feature, y ORDER BY x)),
r AS (SELECT feature, x, y, ny, least({k}, ny - 1) AS kk, {near} AS r FROM w),
p AS (SELECT feature, x, count(*) AS here, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS upto FROM d GROUP BY feature, x),
q AS (SELECT r.*, x + r AS hi, x - r AS lo FROM r),
m AS (SELECT q.*, CASE WHEN q.r = 0 THEN e.here ELSE coalesce(h.upto, 0) - coalesce(l.upto, 0) END AS m
  FROM q JOIN p e ON e.feature = q.feature AND e.x = q.x ASOF LEFT JOIN p h ON h.feature = q.feature AND q.hi > h.x
  ASOF LEFT JOIN p l ON l.feature = q.feature AND q.lo >= l.x),
s AS (SELECT feature, round(greatest(0.0, {_psi('count(*)')} + avg({_psi('kk')}) - avg({_psi('ny')}) - avg({_psi('m')})), 6) AS mi FROM m GROUP BY feature)"""


_M4N_COLS = ["age", "total", "sp_economy"]


@register("m4_neighbour_information", with_frames("basket", f"""
b AS (SELECT id, age, {TOTAL} AS total, sp_economy, label FROM basket),
{_neighbour_sql(_M4N_COLS, 3)}
SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) <= 2 AS INTEGER) AS selected FROM s"""))
def m4_neighbour_information(spark, sf):
    b, _ = basket_feats(spark, sf)
    mi = neighbour_information(b, _M4N_COLS, "label", 3).withColumn("mi", F.round("mi", 6))
    return M.top_k_flag(mi, "mi", 2)


_M5_COLS = ["age", "total", "sp_economy"]


def _anova_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, round(((B - S * S / N) / (G - 1)) / ((SS - B) / (N - G)), 6) AS f_stat FROM (
  SELECT CAST(sum(n) AS DOUBLE) AS N, sum(s) AS S, sum(ss) AS SS, CAST(count(*) AS DOUBLE) AS G, sum(s * s / n) AS B FROM (
    SELECT label, count(*) AS n, sum(CAST({c} AS DOUBLE)) AS s, sum(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)) AS ss
    FROM b WHERE {c} IS NOT NULL GROUP BY label))""")
    return " UNION ALL ".join(parts)


@register("m5_anova_f", with_frames("basket", f"""
b AS (SELECT id, age, {TOTAL} AS total, sp_economy, label FROM basket),
s AS ({_anova_sql(_M5_COLS)})
SELECT feature, f_stat, CAST(row_number() OVER (ORDER BY f_stat DESC, feature) <= 2 AS INTEGER) AS selected FROM s"""))
def m5_anova_f(spark, sf):
    b, _ = basket_feats(spark, sf)
    return M.top_k_flag(M.anova_f(b, _M5_COLS, "label"), "f_stat", 2)
