"""One key holding a third of all rows: results stay exact and the hot key is spread over buckets."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from fitloom.functions.quantiles import group_quantiles
from fitloom.operators import folds as N
from fitloom.operators import groupstats as G


def _skewed(spark, n=3000):
    # group 0 gets every third row; the rest spread over 200 groups
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 200 + 1).alias("g"),
        ((F.col("id") * 7919) % 1009).cast("double").alias("x"),
        (F.col("id") % 4 == 0).cast("int").alias("y"))


def test_hot_group_rank_and_quantiles_exact(spark):
    df = _skewed(spark)
    got = G.group_avg_rank(df, "g", "x", buckets=16).select("id", "x_grank")
    ref = df.select("id", (F.rank().over(Window.partitionBy("g").orderBy("x"))
                           + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2.0).alias("x_grank"))
    assert got.exceptAll(ref).count() == 0
    q = group_quantiles(df, "g", "x", [0.5, 0.9], ["m", "p9"], buckets=16)
    want = df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    want = want.select("g", F.col("q")[0].alias("m"), F.col("q")[1].alias("p9"))
    assert q.exceptAll(want).count() == 0 and want.exceptAll(q).count() == 0


def test_hot_group_split_over_buckets(spark):
    """The running-count windows are partitioned by (group, bucket): the hot group uses many buckets."""
    df = _skewed(spark)
    edges = df.agg(F.percentile_approx("x", [i / 16 for i in range(1, 16)], 160).alias("e")).first()["e"]
    arr = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
    b = df.where("g = 0").select(F.size(F.filter(arr, lambda e: e < F.col("x"))).alias("b"))
    assert b.distinct().count() >= 8


def test_hot_stratum_positions_exact(spark):
    df = _skewed(spark).withColumn("h", N.md5_of("id"))
    got = N.ordered_position(df, "h", ["g"], prefix_len=2).select("id", "pos")
    ref = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("h")).alias("pos"))
    assert got.exceptAll(ref).count() == 0


def test_hot_group_stats_and_folds(spark):
    df = _skewed(spark)
    s = G.attach_group_stats(df, "g", {"x": ["mean", "max", "median"], "*": ["count"]})
    hot = s.where("g = 0").select("g_size", "g_x_max", "g_x_median").distinct().collect()
    assert len(hot) == 1 and hot[0]["g_size"] == 1000
    f = N.stratified_group_kfold(df, "g", "y", 5)
    N.assert_group_disjoint(f, "g")
