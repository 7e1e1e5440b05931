from pyspark.sql import functions as F

from fitloom.operators import impute as D

SP = ["s1", "s2"]


def test_repair_contradictions(spark):
    rows = [(1, "True", 5.0, 0.0), (2, None, 0.0, None), (3, None, 3.0, 1.0), (4, "False", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, state string, s1 double, s2 double")
    out = {r["id"]: r for r in D.repair_contradictions(df, "state", SP).collect()}
    assert out[1]["state_fixed"] == 1 and out[1]["total_fixed"] == 0.0      # state true -> spends zeroed
    assert out[2]["state_fixed"] == 1                                        # unknown, zero spend -> true
    assert out[3]["state_fixed"] == 0 and out[3]["total_fixed"] == 4.0       # spend > 0 -> false
    assert out[4]["state_fixed"] == 0


def test_rule_cascade(spark):
    rows = [(1, 10, None, None, 0.0, 0.0, None, "AMERICA"), (2, 10, "1", None, 2000.0, 0.0, 40.0, "EUROPE"),
            (3, 11, None, "yes", 5.0, None, -3.0, "ASIA"), (4, 12, None, None, None, None, None, "AFRICA")]
    df = spark.createDataFrame(rows, "id int, g int, state string, vip string, s1 double, s2 double, "
                                     "age double, dest string").withColumn("cat", F.lit(None).cast("string"))
    out = {r["id"]: r for r in D.rule_cascade(df, SP, "state", "vip", "age", "g", ("cat", "dest"),
                                               {"AMERICA": "M", "EUROPE": "B"}, "H").collect()}
    assert out[1]["state_r"] == 1 and out[1]["age_r"] == 40.0 and out[1]["category_r"] == "M"   # group mean
    assert out[2]["state_r"] == 1 and out[2]["vip_r"] == 0                    # in the state, its spend counts as 0
    assert out[3]["vip_r"] == 1 and out[3]["age_r"] == -3.0                   # group mean of its own value
    assert out[4]["age_r"] == 35.0 and out[4]["category_r"] == "H"            # no group age, state from spend


def test_cluster_fills(spark):
    rows = [(1, 0, 1.0, "a", True), (2, 0, 3.0, "a", True), (3, 0, None, None, None), (4, 1, None, None, None),
            (5, 1, None, "b", False), (6, 2, 10.0, "b", None)]
    df = spark.createDataFrame(rows, "id int, cl int, x double, c string, b boolean")
    out = {r["id"]: r for r in D.cluster_fill(df, "cl", ["x"], ["c"]).collect()}
    assert out[3]["x"] == 2.0 and out[3]["c"] == "a"          # cluster median / mode
    assert out[4]["x"] == 3.0                                  # all-NULL cluster -> global median
    assert out[4]["c"] == "b"
    v = {r["id"]: r["bv"] for r in D.vote_fill(df.withColumn("cl2", F.lit(0)), "b", ["cl", "cl2"], "bv").collect()}
    assert v[3] is True          # rates 1.0 (cl 0) and 2/3 overall -> mean > 0.5
    assert v[6] is True          # cluster 2 has no known value: only the overall rate counts
    assert v[5] is False


def test_conditional_quantile_fill(spark):
    rows = [(1, 0, 1.0, False, False), (2, 0, 2.0, False, False), (3, 0, 3.0, False, False), (4, 0, 4.0, False, False),
            (5, 0, None, True, False), (6, 0, None, False, True), (7, 0, None, False, False), (8, 1, None, False, False)]
    df = spark.createDataFrame(rows, "id int, cl int, x double, st boolean, vip boolean")
    out = {r["id"]: r["xf"] for r in D.conditional_quantile_fill(df, "x", "cl", "st", "vip", 0.7, "xf").collect()}
    assert out[5] == 0.0                       # state true
    assert abs(out[6] - 3.1) < 1e-12           # VIP: cluster q0.7 of 1..4 = 3.1
    assert out[7] == 2.5                       # cluster median
    assert out[8] == 0.0                       # empty cluster
