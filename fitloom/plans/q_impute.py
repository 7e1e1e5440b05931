"""Queries for imputation and repair (D*). Fixed cluster ids: grp % 6 / 8 / 10 / 12."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.operators import impute as D
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import SPEND_COLS, basket

TOTAL = X.row_sum()


def tol(c):
    s = f"lower(trim(CAST({c} AS VARCHAR)))"
    return f"(CASE WHEN {s} IN ('true', '1', 'yes') THEN 1 WHEN {s} IN ('false', '0', 'no') THEN 0 END)"


def clustered(spark, sf):
    """basket + fixed cluster ids, persisted: the cluster fits and the final fill all read it."""
    from fitloom.session import keep_for_reuse

    b = basket(spark, sf)
    return keep_for_reuse(b.withColumns({f"cl{k}": (F.col("grp") % k).cast("int") for k in (6, 8, 10, 12)}))


CL = "b AS (SELECT *, CAST(grp % 6 AS INTEGER) AS cl6, CAST(grp % 8 AS INTEGER) AS cl8, " \
     "CAST(grp % 10 AS INTEGER) AS cl10, CAST(grp % 12 AS INTEGER) AS cl12 FROM basket)"


def mode_sql(src, key, col, name):
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return (f"{name} AS (SELECT {k}{col} AS {name}_v FROM (SELECT {k}{col}, row_number() OVER ({part}ORDER BY n DESC, {col}) AS rn "
            f"FROM (SELECT {k}{col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY ALL)) WHERE rn = 1)")


@register("d1_constant_fill", with_frames("basket", """
SELECT id, coalesce(planet_n, 'MISSING') AS planet_f, coalesce(state_n, false) AS state_f,
       coalesce(sp_economy, 0.0) AS econ_f FROM basket"""))
def d1_constant_fill(spark, sf):
    b = D.fill_constant(basket(spark, sf), {"planet_n": "MISSING", "state_n": False, "sp_economy": 0.0}, "_f")
    return b.select("id", F.col("planet_n_f").alias("planet_f"), F.col("state_n_f").alias("state_f"),
                    F.col("sp_economy_f").alias("econ_f"))


@register("d2_global_median_fill", with_frames("basket", """
m AS (SELECT median(age_n) AS m FROM basket WHERE split = 'train')
SELECT id, round(coalesce(age_n, m), 6) AS age_filled FROM basket, m"""))
def d2_global_median_fill(spark, sf):
    b = basket(spark, sf)
    med = D.fit_global_median(b.where(F.col("split") == "train"), ["age_n"])
    return b.select("id", F.round(F.coalesce("age_n", F.lit(med["age_n"])), 6).alias("age_filled"))


@register("d3_global_mode_fill", with_frames("basket", f"""
tr AS (SELECT * FROM basket WHERE split = 'train'),
{mode_sql('tr', None, 'planet_n', 'm')}
SELECT id, coalesce(planet_n, (SELECT m_v FROM m), 'HOUSEHOLD') AS planet_filled FROM basket"""))
def d3_global_mode_fill(spark, sf):
    b = basket(spark, sf)
    m = D.fit_global_mode(b.where(F.col("split") == "train"), "planet_n", "HOUSEHOLD")
    return b.select("id", F.coalesce("planet_n", F.lit(m)).alias("planet_filled"))


@register("d4_conditional_fill", with_frames("basket", """
m AS (SELECT coalesce(avg(sp_economy), 0.0) AS m FROM basket WHERE split = 'train' AND state_n = false)
SELECT id, round(coalesce(sp_economy, CASE WHEN state_n = true THEN 0.0 WHEN state_n = false THEN m END), 6)
  AS econ_filled FROM basket, m"""))
def d4_conditional_fill(spark, sf):
    b = basket(spark, sf)
    out = D.conditional_fill(b, b.where(F.col("split") == "train"), "sp_economy", "state_n", "econ_filled")
    return out.select("id", F.round("econ_filled", 6).alias("econ_filled"))


@register("d5_cascade_median_fill", with_frames("basket", """
g AS (SELECT planet_n, median(sp_economy) AS gm FROM basket WHERE sp_economy IS NOT NULL AND planet_n IS NOT NULL
      GROUP BY planet_n),
a AS (SELECT median(sp_economy) AS am FROM basket WHERE sp_economy IS NOT NULL)
SELECT id, round(coalesce(sp_economy, gm, am), 6) AS econ_filled FROM basket LEFT JOIN g USING (planet_n), a"""))
def d5_cascade_median_fill(spark, sf):
    out = D.group_stat_fill(basket(spark, sf), "sp_economy", "planet_n", "econ_filled", default="global")
    return out.select("id", F.round("econ_filled", 6).alias("econ_filled"))


@register("d6_category_stat_fill", with_frames("basket", """
g AS (SELECT dest, median(age_n) AS gm FROM basket WHERE age_n > 0 AND dest IS NOT NULL GROUP BY dest)
SELECT id, round(coalesce(age_n, gm, 0.0), 6) AS age_filled FROM basket LEFT JOIN g USING (dest)"""))
def d6_category_stat_fill(spark, sf):
    out = D.group_stat_fill(basket(spark, sf), "age_n", "dest", "age_filled", where=F.col("age_n") > 0, default=0.0)
    return out.select("id", F.round("age_filled", 6).alias("age_filled"))


# Secondary-column rules for the category fill of the rule cascade.
DEST_TO_SEGMENT = {"AMERICA": "MACHINERY", "EUROPE": "BUILDING", "ASIA": "AUTOMOBILE"}


@register("d7_rule_cascade", with_frames("basket", f"""
gm AS (SELECT grp, avg(age_n) AS gm FROM basket WHERE age_n IS NOT NULL GROUP BY grp),
r AS (SELECT id, age_n, planet_n, dest, gm,
  coalesce({tol('state_n')}, CASE WHEN {TOTAL} = 0 THEN 1 WHEN {TOTAL} > 0 THEN 0 END, 0) AS state_r,
  coalesce({tol('vip')}, CASE WHEN state_r <> 1 AND {TOTAL} > 1000.0 THEN 1 END, 0) AS vip_r
  FROM basket LEFT JOIN gm USING (grp))
SELECT id, state_r, vip_r,
  round(CASE WHEN age_n IS NOT NULL AND age_n > 0 THEN age_n WHEN gm IS NOT NULL THEN gm
             WHEN state_r = 1 THEN 35.0 ELSE 29.0 END, 6) AS age_r,
  coalesce(planet_n, CASE WHEN dest = 'AMERICA' THEN 'MACHINERY' WHEN dest = 'EUROPE' THEN 'BUILDING'
                          WHEN dest = 'ASIA' THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END) AS category_r
FROM r"""))
def d7_rule_cascade(spark, sf):
    out = D.rule_cascade(basket(spark, sf), SPEND_COLS, "state_n", "vip", "age_n", "grp",
                         ("planet_n", "dest"), DEST_TO_SEGMENT, "HOUSEHOLD")
    return out.select("id", "state_r", "vip_r", F.round("age_r", 6).alias("age_r"), "category_r")


def _fixed_sql():
    s = tol("state_n")
    fixed = (f"CASE WHEN {s} = 1 THEN 1 WHEN {TOTAL} > 0 THEN 0 WHEN {s} IS NULL AND {TOTAL} = 0 THEN 1 ELSE {s} END")
    cols = ", ".join(f"CASE WHEN fx = 1 THEN 0.0 ELSE {c} END AS {c}_fixed" for c in SPEND_COLS)
    return with_frames("basket", f"""
f AS (SELECT id, {', '.join(SPEND_COLS)}, {fixed} AS fx FROM basket),
g AS (SELECT id, fx, {cols} FROM f)
SELECT id, fx AS state_fixed, sp_economy_fixed, {X.row_sum([c + '_fixed' for c in SPEND_COLS])} AS total_fixed FROM g""")


@register("d8_repair_contradictions", _fixed_sql())
def d8_repair_contradictions(spark, sf):
    out = D.repair_contradictions(basket(spark, sf), "state_n", SPEND_COLS)
    return out.select("id", "state_fixed", "sp_economy_fixed", "total_fixed")


@register("d9_cluster_fill", with_frames("basket", f"""
{CL},
m AS (SELECT cl6, median(age_n) AS m FROM b GROUP BY cl6),
g AS (SELECT median(age_n) AS g FROM b),
{mode_sql('b', 'cl6', 'planet_n', 'pm')},
{mode_sql('b', None, 'planet_n', 'pg')},
{mode_sql('b', 'cl6', 'state_n', 'sm')},
{mode_sql('b', None, 'state_n', 'sg')}
SELECT id, round(coalesce(age_n, m, g), 6) AS age_c, coalesce(planet_n, pm_v, (SELECT pg_v FROM pg)) AS planet_c,
       coalesce(state_n, sm_v, (SELECT sg_v FROM sg)) AS state_c
FROM b LEFT JOIN m USING (cl6) LEFT JOIN pm USING (cl6) LEFT JOIN sm USING (cl6), g"""))
def d9_cluster_fill(spark, sf):
    out = D.cluster_fill(clustered(spark, sf), "cl6", ["age_n"], ["planet_n", "state_n"])
    return out.select("id", F.round("age_n", 6).alias("age_c"), F.col("planet_n").alias("planet_c"),
                      F.col("state_n").alias("state_c"))


@register("d10_cluster_rate_gate", with_frames("basket", f"""
{CL},
s AS (SELECT cl6, avg(CAST(state AS DOUBLE)) AS rate, median(sp_economy) AS med FROM b GROUP BY cl6)
SELECT id, round(coalesce(sp_economy, CASE WHEN rate > 0.7 THEN 0.0 ELSE coalesce(med, 0.0) END), 6) AS econ_g
FROM b LEFT JOIN s USING (cl6)"""))
def d10_cluster_rate_gate(spark, sf):
    out = D.cluster_rate_gate(clustered(spark, sf), "cl6", "state", "sp_economy", "econ_g")
    return out.select("id", F.round("econ_g", 6).alias("econ_g"))


_MV = "list_sort(list_filter([m8, m10, m12], lambda x: x IS NOT NULL))"


@register("d11_multiview_median", with_frames("basket", f"""
{CL},
a AS (SELECT cl8, median(age_n) AS m8 FROM b GROUP BY cl8),
c AS (SELECT cl10, median(age_n) AS m10 FROM b GROUP BY cl10),
d AS (SELECT cl12, median(age_n) AS m12 FROM b GROUP BY cl12),
g AS (SELECT median(age_n) AS g FROM b),
j AS (SELECT id, age_n, {_MV} AS v, g FROM b LEFT JOIN a USING (cl8) LEFT JOIN c USING (cl10) LEFT JOIN d USING (cl12), g)
SELECT id, round(coalesce(age_n, CASE WHEN len(v) = 0 THEN g WHEN len(v) % 2 = 1 THEN v[CAST(floor((len(v) + 1) / 2) AS INTEGER)]
  ELSE (v[CAST(floor(len(v) / 2) AS INTEGER)] + v[CAST(floor(len(v) / 2) AS INTEGER) + 1]) / 2 END), 6) AS age_mv FROM j"""))
def d11_multiview_median(spark, sf):
    out = D.multiview_median_fill(clustered(spark, sf), "age_n", ["cl8", "cl10", "cl12"], "age_mv")
    return out.select("id", F.round("age_mv", 6).alias("age_mv"))


@register("d12_conditional_quantile_fill", with_frames("basket", f"""
{CL},
q AS (SELECT cl10, quantile_cont(sp_large, [0.7, 0.5]) AS q FROM b GROUP BY cl10)
SELECT id, round(coalesce(sp_large, CASE WHEN {tol('state_n')} = 1 THEN 0.0 ELSE
  coalesce(greatest(0.0, CASE WHEN {tol('vip')} = 1 THEN q[1] ELSE q[2] END), 0.0) END), 6) AS large_f
FROM b LEFT JOIN q USING (cl10)"""))
def d12_conditional_quantile_fill(spark, sf):
    out = D.conditional_quantile_fill(clustered(spark, sf), "sp_large", "cl10", "state_n", "vip", 0.7, "large_f")
    return out.select("id", F.round("large_f", 6).alias("large_f"))


@register("d13_vote_fill", with_frames("basket", f"""
{CL},
a AS (SELECT cl8, avg(CAST({tol('state_n')} AS DOUBLE)) AS r8 FROM b GROUP BY cl8),
c AS (SELECT cl10, avg(CAST({tol('state_n')} AS DOUBLE)) AS r10 FROM b GROUP BY cl10),
d AS (SELECT cl12, avg(CAST({tol('state_n')} AS DOUBLE)) AS r12 FROM b GROUP BY cl12),
j AS (SELECT id, state_n, r8, r10, r12,
  (CASE WHEN r8 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN r10 IS NOT NULL THEN 1 ELSE 0 END)
  + (CASE WHEN r12 IS NOT NULL THEN 1 ELSE 0 END) AS present,
  coalesce(r8, 0.0) + coalesce(r10, 0.0) + coalesce(r12, 0.0) AS total
  FROM b LEFT JOIN a USING (cl8) LEFT JOIN c USING (cl10) LEFT JOIN d USING (cl12))
SELECT id, coalesce(state_n, CASE WHEN present > 0 THEN total / present > 0.5 ELSE false END) AS state_v FROM j"""))
def d13_vote_fill(spark, sf):
    out = D.vote_fill(clustered(spark, sf), "state_n", ["cl8", "cl10", "cl12"], "state_v")
    return out.select("id", "state_v")


@register("d14_hierarchical_mode", with_frames("basket", f"""
{CL},
{mode_sql('b', 'cl6', 'planet_n', 'a')},
{mode_sql('b', 'cl8', 'planet_n', 'c')},
{mode_sql('b', None, 'planet_n', 'g')}
SELECT id, coalesce(planet_n, a_v, c_v, (SELECT g_v FROM g)) AS planet_h
FROM b LEFT JOIN a USING (cl6) LEFT JOIN c USING (cl8)"""))
def d14_hierarchical_mode(spark, sf):
    out = D.hierarchical_mode_fill(clustered(spark, sf), "planet_n", ["cl6", "cl8"], "planet_h")
    return out.select("id", "planet_h")


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "nan"]
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register("d15_typed_preprocess", with_frames("basket", """
md AS (SELECT median(age_n) AS ma, median(sp_economy) AS me FROM basket),
sc AS (SELECT avg(coalesce(age_n, ma)) AS mua, stddev_pop(coalesce(age_n, ma)) AS sda,
              avg(coalesce(sp_economy, me)) AS mue, stddev_pop(coalesce(sp_economy, me)) AS sde FROM basket, md)
SELECT id, round((coalesce(age_n, ma) - mua) / CASE WHEN sda = 0 THEN 1.0 ELSE sda END, 9) AS age_n,
  round((coalesce(sp_economy, me) - mue) / CASE WHEN sde = 0 THEN 1.0 ELSE sde END, 9) AS sp_economy, """ + ", ".join(
    [f"CAST(coalesce(planet_n, 'nan') = '{v}' AS INTEGER) AS planet_n_{v}" for v in _SEGS]
    + [f"CAST(dest = '{v}' AS INTEGER) AS \"dest_{v}\"" for v in _REGIONS]) + " FROM basket, md, sc"))
def d15_typed_preprocess(spark, sf):
    b = basket(spark, sf)
    out = D.typed_preprocess(b, b, ["age_n", "sp_economy"], ["planet_n", "dest"], keep=["id"])
    return out.withColumns({c: F.round(c, 9) for c in ["age_n", "sp_economy"]})


# ---------------------------------------------------------------- both sides of every rule
# A state that contradicts the spend (true with spend, NULL, false without), a VIP flag with NULLs, and clusters
# by id in which the state rate is 1, about a half and 0.

CONFLICTS = """c AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN true WHEN id % 5 = 1 THEN NULL ELSE false END AS state_n,
  CASE WHEN id % 3 = 0 THEN NULL ELSE vip END AS vip,
  (id % 4 = 0 OR (id % 4 = 1 AND id % 3 = 0)) AS state), CAST(id % 4 AS INTEGER) AS cl4, CAST(id % 8 AS INTEGER) AS cl8,
  CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 4 = 0 OR (id % 4 = 1 AND id % 3 = 0)) END AS state_m FROM basket)"""


def conflicts(spark, sf):
    b = basket(spark, sf)
    k = F.col("id")
    state = (k % 4 == 0) | ((k % 4 == 1) & (k % 3 == 0))
    return b.withColumns({
        "state_n": F.when(k % 5 == 0, True).when(k % 5 == 1, None).otherwise(False),
        "vip": F.when(k % 3 == 0, None).otherwise(F.col("vip")), "state": state,
        "cl4": (k % 4).cast("int"), "cl8": (k % 8).cast("int"), "state_m": F.when(k % 7 == 0, None).otherwise(state)})


@register("d7_rule_cascade_conflicts", with_frames("basket", f"""
{CONFLICTS},
r AS (SELECT id, coalesce({tol('state_n')}, CASE WHEN {TOTAL} = 0 THEN 1 WHEN {TOTAL} > 0 THEN 0 END, 0) AS state_r,
  coalesce({tol('vip')}, CASE WHEN state_r <> 1 AND {TOTAL} > 1000.0 THEN 1 END, 0) AS vip_r,
  CASE WHEN id % 6 = 0 THEN 'Unknown' WHEN id % 6 < 4 THEN NULL WHEN id % 6 = 4 THEN 'P' ELSE 'S' END AS side FROM c)
SELECT id, state_r, vip_r, CASE WHEN side <> 'Unknown' THEN side WHEN vip_r = 1 THEN 'P' ELSE 'S' END AS side_r FROM r"""))
def d7_rule_cascade_conflicts(spark, sf):
    out = D.rule_cascade(conflicts(spark, sf), SPEND_COLS, "state_n", "vip", "age_n", "grp",
                         ("planet_n", "dest"), DEST_TO_SEGMENT, "HOUSEHOLD")
    k = F.col("id") % 6
    out = out.withColumn("side", F.when(k == 0, "Unknown").when(k < 4, None).when(k == 4, "P").otherwise("S"))
    return D.side_from_vip(out, "side", "vip_r", "side_r").select("id", "state_r", "vip_r", "side_r")


_TOL_S = tol("state_n")


@register("d8_repair_contradictions_conflicts", with_frames("basket", f"""
{CONFLICTS},
f AS (SELECT *, CASE WHEN {_TOL_S} = 1 THEN 1 WHEN {TOTAL} > 0 THEN 0 WHEN {_TOL_S} IS NULL AND {TOTAL} = 0 THEN 1 ELSE {_TOL_S} END AS fx FROM c)
SELECT id, fx AS state_fixed, CASE WHEN fx = 1 THEN 0.0 ELSE sp_economy END AS sp_economy_fixed FROM f"""))
def d8_repair_contradictions_conflicts(spark, sf):
    return D.repair_contradictions(conflicts(spark, sf), "state_n", SPEND_COLS).select("id", "state_fixed", "sp_economy_fixed")


@register("d10_cluster_rate_gate_conflicts", with_frames("basket", f"""
{CONFLICTS},
s AS (SELECT cl4, avg(CAST(state AS DOUBLE)) AS rate, median(sp_economy) AS med FROM c GROUP BY cl4)
SELECT id, rate > 0.7 AS gated, round(coalesce(sp_economy, CASE WHEN rate > 0.7 THEN 0.0 ELSE coalesce(med, 0.0) END), 6) AS econ_g
FROM c LEFT JOIN s USING (cl4)"""))
def d10_cluster_rate_gate_conflicts(spark, sf):
    out = D.cluster_rate_gate(conflicts(spark, sf), "cl4", "state", "sp_economy", "econ_g")
    return out.select("id", (F.col("cl4") == 0).alias("gated"), F.round("econ_g", 6).alias("econ_g"))


@register("d13_vote_fill_conflicts", with_frames("basket", f"""
{CONFLICTS},
a AS (SELECT cl4, avg(CAST(state_m AS DOUBLE)) AS r4 FROM c GROUP BY cl4),
e AS (SELECT cl8, avg(CAST(state_m AS DOUBLE)) AS r8 FROM c GROUP BY cl8)
SELECT id, coalesce(state_m, (coalesce(r4, 0.0) + coalesce(r8, 0.0)) / ((r4 IS NOT NULL)::INT + (r8 IS NOT NULL)::INT) > 0.5) AS state_v
FROM c LEFT JOIN a USING (cl4) LEFT JOIN e USING (cl8)"""))
def d13_vote_fill_conflicts(spark, sf):
    return D.vote_fill(conflicts(spark, sf), "state_m", ["cl4", "cl8"], "state_v").select("id", "state_v")


@register("q11_rule_compliance_conflicts", with_frames("basket", f"""
{CONFLICTS},
t AS (SELECT count(*) FILTER (WHERE coalesce(state_n, false)) AS n_applicable,
  count(*) FILTER (WHERE coalesce(state_n, false) AND {TOTAL} = 0) AS n_valid FROM c)
SELECT n_applicable, n_valid, n_applicable - n_valid AS n_violation,
  round(CAST(n_valid AS DOUBLE) / nullif(n_applicable, 0), 12) AS share_valid FROM t"""))
def q11_rule_compliance_conflicts(spark, sf):
    from fitloom.functions.rowwise import row_sum
    from fitloom.operators import metrics as Q

    return Q.rule_compliance(conflicts(spark, sf), F.col("state_n"), row_sum(SPEND_COLS) == 0)
