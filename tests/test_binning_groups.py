from pyspark.sql import functions as F

from fitloom.operators import binning as E
from fitloom.operators import groupstats as G


def test_cut_fixed_edges(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (12.5,), (100.0,), (101.0,), (None,)], "x double")
    edges = [0.0, 12.0, 100.0]
    right = [r[0] for r in df.select(E.cut_fixed("x", edges, ["a", "b"])).collect()]
    low = [r[0] for r in df.select(E.cut_fixed("x", edges, ["a", "b"], include_lowest=True)).collect()]
    assert right == [None, "a", "b", "b", None, None]       # (0, 12], (12, 100]; lowest edge excluded
    assert low == ["a", "a", "b", "b", None, None]


def test_qcut_duplicate_edges(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    edges = E.fit_quantile_edges(df, "x", 4)
    assert edges[0] == 0.0 and len(edges) == len(set(edges)) < 5
    codes = [r[0] for r in df.select(E.cut_by_edges("x", edges)).collect()]
    assert codes[:6] == [0] * 6 and max(codes) == len(edges) - 2


def test_equal_width_constant_and_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,)], "x double")
    lo, hi = E.fit_equal_width(df, "x")
    assert {r[0] for r in df.select(E.cut_equal_width("x", lo, hi, 10)).collect()} == {4}
    d2 = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    assert [r[0] for r in d2.select(E.cut_equal_width("x", 0.0, 10.0, 2)).collect()] == [0, 0, 1]


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None)], "g int, v string")
    got = {r["g"]: r["v_mode"] for r in G.group_mode(df, "g", "v").collect()}
    assert got == {1: "a", 2: None}


def test_singleton_std_and_avg_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (2, 3.0), (2, 7.0)], "g int, x double")
    s = {(r["g"], r["x"]): r for r in G.attach_group_stats(df, "g", {"x": ["std"]}).collect()}
    assert s[(1, 5.0)]["g_x_std"] == 0.0
    r = {(row["g"], row["x"]): row["x_grank"] for row in G.group_avg_rank(df, "g", "x").collect()}
    assert r[(2, 1.0)] == 1.0 and r[(2, 3.0)] == 2.5 and r[(2, 7.0)] == 4.0 and r[(1, 5.0)] == 1.0


def test_group_stats_broadcast_plan(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("x"))
    plan = G.attach_group_stats(df, "g", {"x": ["mean"]})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_exact_quantiles_match_percentile(spark):
    from fitloom.functions.quantiles import exact_quantiles

    rows = [((i * 7919) % 1013 / 7.0 if i % 5 else 3.0,) for i in range(3000)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).first()["q"]
    # a tiny collect bound forces several narrowing passes
    got = exact_quantiles(df, "x", probs, bins=8, max_collect=20)
    assert got == want
    assert exact_quantiles(df, "x", probs) == want


def test_group_quantiles_match_percentile(spark):
    from fitloom.functions.quantiles import group_quantiles

    rows = [(i % 4, float((i * 7919) % 101) if i % 9 else None) for i in range(2000)] + [(9, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.25, 0.5, 0.7]
    want = {r["g"]: list(r["q"]) for r in df.groupBy("g").agg(
        F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).collect() if r["q"] is not None}
    got = {r["g"]: [r["a"], r["b"], r["c"]] for r in group_quantiles(df, "g", "x", probs, ["a", "b", "c"], 4).collect()}
    assert got == want


def test_exact_quantiles_multi_columns(spark):
    from fitloom.functions.quantiles import exact_quantiles_multi

    df = spark.range(5000).select((F.col("id") % 97).cast("double").alias("a"),
                                  F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") * 0.5).alias("b"),
                                  F.lit(None).cast("double").alias("c"))
    probs = [0.2, 0.5, 0.9]
    got = exact_quantiles_multi(df, ["a", "b", "c"], probs, bins=16, max_collect=50)
    for col in ("a", "b"):
        want = df.agg(F.percentile(col, F.array(*[F.lit(p) for p in probs])).alias("q")).first()["q"]
        assert got[col] == want
    assert got["c"] == [None, None, None]
