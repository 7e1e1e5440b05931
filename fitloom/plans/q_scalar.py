"""Queries for parsing / scalar functions (B*) and row-wise aggregates (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions import parse as P
from fitloom.functions import rowwise as RW
from fitloom.operators.groupstats import group_size
from fitloom.plans import sqlexpr as X
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources.frames import SPEND_COLS, basket, line
from fitloom.sources.tables import table

BASKET_COLS = ["id", "grp", "age", "planet", "dest", *SPEND_COLS, "state", "state_n", "vip",
               "label", "split", "age_n", "planet_n"]
SP = ", ".join(SPEND_COLS)

# ---------------------------------------------------------------- B1 / B2


@register("b1_drop_columns", with_frames("basket", f"""
SELECT id, grp, age, planet, dest, {SP}, state, vip, label, split FROM basket"""))
def b1_drop_columns(spark, sf):
    return P.drop_columns(basket(spark, sf), ["state_n", "age_n", "planet_n", "not_a_column"])


@register("b1_keep_columns", with_frames("basket", "SELECT id, label, age FROM basket"))
def b1_keep_columns(spark, sf):
    return P.keep_columns(basket(spark, sf), ["id", "label", "missing_col", "age"])


@register("b2_select_numeric", with_frames("basket", f"SELECT id, grp, age, {SP}, label, age_n FROM basket"))
def b2_select_numeric(spark, sf):
    return P.select_by_type(basket(spark, sf), "numeric")


@register("b2_select_categorical", with_frames("basket", "SELECT planet, dest, split, planet_n FROM basket"))
def b2_select_categorical(spark, sf):
    return P.select_by_type(basket(spark, sf), "categorical")


# ---------------------------------------------------------------- B3-B6


@register("b3_split_id", """
SELECT c_custkey, split_part(c_name, '#', 1) AS name_group,
       TRY_CAST(split_part(c_name, '#', 2) AS INTEGER) AS name_member
FROM customer""")
def b3_split_id(spark, sf):
    c = table(spark, sf, "customer")
    g, m = P.split_id("c_name", "#")
    return c.select("c_custkey", g.alias("name_group"), m.alias("name_member"))


_NOSCHEME = "regexp_replace(url, '^[a-z]+://', '')"


@register("b4_split3", f"""
SELECT page_id,
  split_part(coalesce({_NOSCHEME}, 'Unknown/0/Unknown'), '/', 1) AS part1,
  split_part(coalesce({_NOSCHEME}, 'Unknown/0/Unknown'), '/', 2) AS part2,
  split_part(coalesce({_NOSCHEME}, 'Unknown/0/Unknown'), '/', 3) AS part3
FROM pages""")
def b4_split3(spark, sf):
    p = table(spark, sf, "pages")
    a, b, c = P.split3(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return p.select("page_id", a.alias("part1"), b.alias("part2"), c.alias("part3"))


_PATH = "regexp_replace(url, '^[a-z]+://[^/]+/', '')"


@register("b4b_split3_guarded", f"""
WITH s AS (SELECT page_id, {_PATH} AS c, string_split({_PATH}, '/') AS parts FROM pages),
g AS (SELECT page_id, parts, c IS NOT NULL AND length(c) >= 3 AND len(parts) = 3 AS ok FROM s)
SELECT page_id,
  CASE WHEN ok AND parts[1] <> '' THEN parts[1] ELSE 'Unknown' END AS deck,
  CASE WHEN ok THEN coalesce(TRY_CAST(nullif(parts[2], '') AS DOUBLE), 0.0) ELSE 0.0 END AS num,
  CASE WHEN ok AND parts[3] <> '' THEN parts[3] ELSE 'Unknown' END AS side
FROM g""")
def b4b_split3_guarded(spark, sf):
    p = table(spark, sf, "pages")
    a, b, c = P.split3_guarded(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "/")
    return p.select("page_id", a.alias("deck"), b.alias("num"), c.alias("side"))


@register("b5_to_number", f"""
SELECT page_id, TRY_CAST(split_part({_NOSCHEME}, '/', 3) AS DOUBLE) AS path_num FROM pages""")
def b5_to_number(spark, sf):
    p = table(spark, sf, "pages")
    part = F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(3))
    return p.select("page_id", P.to_number(part).alias("path_num"))


@register("b6_regex_capture", """
SELECT o_orderkey, coalesce(nullif(regexp_extract(o_orderpriority, '^1-(.+)$', 1), ''), 'Unknown') AS title
FROM orders""")
def b6_regex_capture(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", P.regex_capture("o_orderpriority", r"^1-(.+)$").alias("title"))


# ---------------------------------------------------------------- B7-B13

_TOKEN_SQL = ("CASE WHEN trim(p_name) IS NULL OR trim(p_name) = '' THEN NULL "
              "ELSE split_part(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' ', 1) END")


@register("b7_first_token", f"SELECT p_partkey, {_TOKEN_SQL} AS first_token FROM part")
def b7_first_token(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.first_token("p_name").alias("first_token"))


# A small token dictionary (token -> raw class) used as the enrichment table.
TOKEN_DICTIONARY = [
    ("hot", "male"), ("red", "mostly_male"), ("small", "female"), ("blue", "mostly_female"),
    ("large", "andy"), ("old", "unknown"),
]
COLLAPSE = {"Male": ["male", "mostly_male"], "Female": ["female", "mostly_female"]}
_DICT_SQL = ", ".join(f"('{t}', '{r}')" for t, r in TOKEN_DICTIONARY)


@register("b8_dictionary_enrich", f"""
WITH d(tok, raw) AS (VALUES {_DICT_SQL}),
t AS (SELECT p_partkey, {_TOKEN_SQL} AS first_token FROM part)
SELECT p_partkey, first_token, raw AS raw_class,
  CASE WHEN raw IN ('male', 'mostly_male') THEN 'Male'
       WHEN raw IN ('female', 'mostly_female') THEN 'Female' ELSE 'Unknown' END AS klass
FROM t LEFT JOIN d ON first_token = tok""")
def b8_dictionary_enrich(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", P.first_token("p_name").alias("first_token"))
    d = spark.createDataFrame(TOKEN_DICTIONARY, "token string, raw_class string")
    out = P.enrich_by_dictionary(parts, "first_token", d, collapse=COLLAPSE)
    return out.select("p_partkey", "first_token", F.col("__raw").alias("raw_class"), "klass")


@register("b9_str_len", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS name_len FROM part")
def b9_str_len(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.str_len("p_name").alias("name_len"))


@register("b10_combine", with_frames("basket", """
SELECT id, coalesce(planet_n, 'nan') || '_' || dest AS route,
       planet_n || '_to_' || dest AS route_nullable FROM basket"""))
def b10_combine(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.combine(["planet_n", "dest"], "_", fill="nan").alias("route"),
                    P.combine(["planet_n", "dest"], "_to_").alias("route_nullable"))


# Canonical spellings for the two enum columns.
PLANETS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
DEST_RULES = [("amer", "AMERICA"), ("euro", "EUROPE"), ("asia", "ASIA")]


@register("b11_canonical_enum", with_frames("basket", """
SELECT id,
  CASE WHEN lower(planet_n) = 'automobile' THEN 'AUTOMOBILE' WHEN lower(planet_n) = 'building' THEN 'BUILDING'
       WHEN lower(planet_n) = 'machinery' THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS planet_c,
  CASE WHEN coalesce(contains(lower(dest), 'amer'), false) THEN 'AMERICA'
       WHEN coalesce(contains(lower(dest), 'euro'), false) THEN 'EUROPE'
       WHEN coalesce(contains(lower(dest), 'asia'), false) THEN 'ASIA' ELSE 'AFRICA' END AS dest_c
FROM basket"""))
def b11_canonical_enum(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.canonical_member("planet_n", PLANETS, "HOUSEHOLD").alias("planet_c"),
                    P.canonical_contains("dest", DEST_RULES, "AFRICA").alias("dest_c"))


@register("b12_tolerant_bool", with_frames("basket", """
SELECT id,
  CASE WHEN lower(trim(CAST(state_n AS VARCHAR))) IN ('true', '1', 'yes') THEN 1
       WHEN lower(trim(CAST(state_n AS VARCHAR))) IN ('false', '0', 'no') THEN 0 ELSE 0 END AS state_i,
  CASE WHEN lower(trim(CAST(label AS VARCHAR))) IN ('true', '1', 'yes') THEN 1
       WHEN lower(trim(CAST(label AS VARCHAR))) IN ('false', '0', 'no') THEN 0 ELSE 0 END AS label_i
FROM basket"""))
def b12_tolerant_bool(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.tolerant_bool("state_n").alias("state_i"), P.tolerant_bool("label").alias("label_i"))


@register("b13_matches_any", """
SELECT p_partkey, CAST(coalesce(regexp_matches(p_name, 'ring|gear'), false) AS INTEGER) AS is_ring_gear FROM part""")
def b13_matches_any(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.matches_any("p_name", ["ring", "gear"]).alias("is_ring_gear"))


# ---------------------------------------------------------------- B14-B25


@register("b14_flags", with_frames("basket", f"""
SELECT id,
  CAST(coalesce(age_n >= 0 AND age_n <= 2500, false) AS INTEGER) AS low_band,
  CAST(coalesce(vip AND {X.row_sum()} > 100000, false) AS INTEGER) AS vip_big,
  CAST(coalesce(sp_economy IS NOT NULL AND sp_promo IS NOT NULL, false) AS INTEGER) AS has_both
FROM basket"""))
def b14_flags(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.flag(F.col("age_n").between(0, 2500)).alias("low_band"),
                    P.flag(F.col("vip") & (RW.row_sum(SPEND_COLS) > 100000)).alias("vip_big"),
                    P.flag(F.col("sp_economy").isNotNull() & F.col("sp_promo").isNotNull()).alias("has_both"))


@register("b15_log1p", with_frames("basket", f"""
SELECT id, round(ln(1 + sp_economy), 9) AS log_economy, round(ln(1 + {X.row_sum()}), 9) AS log_total FROM basket"""))
def b15_log1p(spark, sf):
    b = basket(spark, sf)
    return b.select("id", F.round(P.log1p("sp_economy"), 9).alias("log_economy"),
                    F.round(P.log1p(RW.row_sum(SPEND_COLS)), 9).alias("log_total"))


@register("b16_sqrt", with_frames("basket", f"SELECT id, sqrt({X.row_sum()}) AS sqrt_total FROM basket"))
def b16_sqrt(spark, sf):
    return basket(spark, sf).select("id", P.sqrt(RW.row_sum(SPEND_COLS)).alias("sqrt_total"))


@register("b17_square", with_frames("basket", "SELECT id, age * age AS age_sq, sp_large * sp_large AS large_sq FROM basket"))
def b17_square(spark, sf):
    return basket(spark, sf).select("id", P.square("age").alias("age_sq"), P.square("sp_large").alias("large_sq"))


@register("b18_int_positions", with_frames("basket", """
SELECT id, id % 2 AS parity, CAST(floor(id / 100) AS BIGINT) AS hundreds, id % 100 AS within_hundred,
  CAST(floor(age / 10) * 10 AS BIGINT) AS age_decade, CAST(id % 100 < 10 AS INTEGER) AS edge
FROM basket"""))
def b18_int_positions(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.int_mod("id", 2).alias("parity"), P.int_div("id", 100).alias("hundreds"),
                    P.int_mod("id", 100).alias("within_hundred"), P.decade("age").alias("age_decade"),
                    (P.int_mod("id", 100) < 10).cast("int").alias("edge"))


@register("b19_guarded_ratio", with_frames("basket", f"""
SELECT id, sp_economy / ({X.row_sum()} + 1.0) AS economy_share,
       {X.row_sum()} / (age + 1e-9) AS spend_per_age FROM basket"""))
def b19_guarded_ratio(spark, sf):
    b = basket(spark, sf)
    t = RW.row_sum(SPEND_COLS)
    return b.select("id", P.guarded_ratio("sp_economy", t, 1.0).alias("economy_share"),
                    P.guarded_ratio(t, F.col("age"), 1e-9).alias("spend_per_age"))


@register("b20_products", with_frames("basket", f"""
SELECT id, CAST(vip AS DOUBLE) * {X.row_sum()} AS vip_spend, CAST(state AS DOUBLE) * age AS state_age FROM basket"""))
def b20_products(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.product(F.col("vip"), RW.row_sum(SPEND_COLS)).alias("vip_spend"),
                    P.product(F.col("state"), F.col("age")).alias("state_age"))


@register("b21_equal_flag", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(coalesce(l_returnflag = l_linestatus, false) AS INTEGER) AS flags_equal FROM lineitem""")
def b21_equal_flag(spark, sf):
    li = line(spark, sf)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     P.equal_flag("l_returnflag", "l_linestatus").alias("flags_equal"))


# Priority -> score dictionary (one label deliberately absent).
PRIORITY_SCORE = {"1-URGENT": 5.0, "2-HIGH": 4.0, "3-MEDIUM": 3.0, "4-NOT SPECIFIED": 2.5}


@register("b22_map_values", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 4.0
  WHEN '3-MEDIUM' THEN 3.0 WHEN '4-NOT SPECIFIED' THEN 2.5 END::DOUBLE AS priority_score FROM orders""")
def b22_map_values(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", P.map_values("o_orderpriority", PRIORITY_SCORE).alias("priority_score"))


@register("b23_missing_flags", with_frames("basket", """
SELECT id, CAST(sp_economy IS NULL AS INTEGER) AS sp_economy_missing,
  CAST(sp_small IS NULL AS INTEGER) AS sp_small_missing, CAST(age_n IS NULL AS INTEGER) AS age_missing FROM basket"""))
def b23_missing_flags(spark, sf):
    b = basket(spark, sf)
    return b.select("id", P.missing_flag("sp_economy").alias("sp_economy_missing"),
                    P.missing_flag("sp_small").alias("sp_small_missing"),
                    P.missing_flag("age_n").alias("age_missing"))


_ALL_NULLABLE = [*SPEND_COLS, "state_n", "age_n", "planet_n"]


@register("b24_missing_count", with_frames("basket", "SELECT id, " + " + ".join(
    f"CAST({c} IS NULL AS INTEGER)" for c in _ALL_NULLABLE) + " AS n_missing FROM basket"))
def b24_missing_count(spark, sf):
    return basket(spark, sf).select("id", P.missing_count(_ALL_NULLABLE).alias("n_missing"))


@register("b25_band_predicates", with_frames("preds", """
SELECT row_id, member, CAST(coalesce(prob > 0.3 AND prob < 0.7, false) AS INTEGER) AS uncertain,
       CAST(coalesce(member BETWEEN 2 AND 3, false) AS INTEGER) AS mid_member FROM preds"""))
def b25_band_predicates(spark, sf):
    from fitloom.sources.frames import preds

    p = preds(spark, sf)
    return p.select("row_id", "member", P.open_band("prob", 0.3, 0.7).alias("uncertain"),
                    P.closed_band("member", 2, 3).alias("mid_member"))


# ---------------------------------------------------------------- C1-C11


@register("c1_row_sum", with_frames("basket", f"SELECT id, {X.row_sum()} AS total FROM basket"))
def c1_row_sum(spark, sf):
    return basket(spark, sf).select("id", RW.row_sum(SPEND_COLS).alias("total"))


@register("c2_row_max_min", with_frames("basket", f"""
SELECT id, greatest({SP}) AS sp_max, least({SP}) AS sp_min, greatest({SP}) - least({SP}) AS sp_range FROM basket"""))
def c2_row_max_min(spark, sf):
    return basket(spark, sf).select("id", RW.row_max(SPEND_COLS).alias("sp_max"), RW.row_min(SPEND_COLS).alias("sp_min"),
                                    RW.row_range(SPEND_COLS).alias("sp_range"))


@register("c3_row_var_std", with_frames("basket", f"""
SELECT id, {X.row_var()} AS sp_var, sqrt({X.row_var()}) AS sp_std FROM basket"""))
def c3_row_var_std(spark, sf):
    b = basket(spark, sf).withColumn("__m", RW.row_mean(SPEND_COLS))
    v = RW.row_var(SPEND_COLS, F.col("__m"))
    return b.withColumn("sp_var", v).select("id", "sp_var", F.sqrt("sp_var").alias("sp_std"))


@register("c4_row_skew", with_frames("basket", f"SELECT id, round({X.row_skew()}, 9) AS sp_skew FROM basket"))
def c4_row_skew(spark, sf):
    b = basket(spark, sf).withColumn("__m", RW.row_mean(SPEND_COLS))
    return b.select("id", F.round(RW.row_skew(SPEND_COLS, F.col("__m")), 9).alias("sp_skew"))


@register("c5_row_median", with_frames("basket", f"SELECT id, {X.row_median()} AS sp_median FROM basket"))
def c5_row_median(spark, sf):
    return basket(spark, sf).select("id", RW.row_median(SPEND_COLS).alias("sp_median"))


@register("c6_positive_count", with_frames("basket", f"""
SELECT id, {X.positive_count()} AS n_positive, CAST({X.positive_count()} > 0 AS INTEGER) AS any_positive FROM basket"""))
def c6_positive_count(spark, sf):
    return basket(spark, sf).select("id", RW.positive_count(SPEND_COLS).alias("n_positive"),
                                    RW.any_positive(SPEND_COLS).alias("any_positive"))


@register("c7_argmax_name", with_frames("basket", f"SELECT id, {X.argmax_name()} AS max_category FROM basket"))
def c7_argmax_name(spark, sf):
    return basket(spark, sf).select("id", RW.argmax_name(SPEND_COLS).alias("max_category"))


@register("c8_concentration", with_frames("basket", f"""
SELECT id, coalesce(greatest({SP}), 0.0) / ({X.row_sum()} + 1) AS concentration FROM basket"""))
def c8_concentration(spark, sf):
    return basket(spark, sf).select("id", RW.concentration(SPEND_COLS).alias("concentration"))


@register("c9_spend_entropy", with_frames("basket", f"SELECT id, round({X.entropy()}, 9) AS entropy FROM basket"))
def c9_spend_entropy(spark, sf):
    return basket(spark, sf).select("id", F.round(RW.spend_entropy(SPEND_COLS), 9).alias("entropy"))


@register("c10_per_head", with_frames("basket", f"""
g AS (SELECT grp, count(*) AS g_size FROM basket GROUP BY grp)
SELECT id, {X.row_sum()} / (g_size + 1.0) AS per_head1, {X.row_sum()} / (g_size + 0.0) AS per_head
FROM basket JOIN g USING (grp)"""))
def c10_per_head(spark, sf):
    b = group_size(basket(spark, sf), "grp")
    t = RW.row_sum(SPEND_COLS)
    return b.select("id", RW.per_head(t, F.col("g_size"), 1.0).alias("per_head1"),
                    RW.per_head(t, F.col("g_size"), 0.0).alias("per_head"))


@register("c11_subset_share", with_frames("basket", f"""
SELECT id, {X.row_sum(['sp_economy', 'sp_large'])} / ({X.row_sum()} + 1) AS econ_large_share,
  CAST(coalesce(sp_economy > 0, false) OR coalesce(sp_large > 0, false) AS INTEGER) AS uses_econ_large
FROM basket"""))
def c11_subset_share(spark, sf):
    b = basket(spark, sf)
    return b.select("id", RW.subset_share(["sp_economy", "sp_large"], SPEND_COLS).alias("econ_large_share"),
                    RW.any_used(["sp_economy", "sp_large"]).alias("uses_econ_large"))
