import math

from pyspark.sql import functions as F

from fitloom.functions import parse as P
from fitloom.functions import rowwise as RW


def test_guarded_split_malformed(spark):
    df = spark.createDataFrame([("A/12/P",), ("/5/",), ("B/7",), ("C/x/S",), (None,), ("ab",)], "c string")
    a, n, s = P.split3_guarded("c")
    rows = df.select("c", a.alias("a"), n.alias("n"), s.alias("s")).collect()
    got = {r["c"]: (r["a"], r["n"], r["s"]) for r in rows}
    assert got["A/12/P"] == ("A", 12.0, "P")
    assert got["/5/"] == ("Unknown", 5.0, "Unknown")          # empty parts -> their defaults
    assert got["B/7"] == ("Unknown", 0.0, "Unknown")          # wrong arity
    assert got["C/x/S"] == ("C", 0.0, "S")                    # non-numeric middle
    assert got[None] == ("Unknown", 0.0, "Unknown")
    assert got["ab"] == ("Unknown", 0.0, "Unknown")           # too short


def test_tolerant_bool_and_regex(spark):
    df = spark.createDataFrame([("True",), ("yes",), ("0",), ("maybe",), (None,)], "c string")
    vals = [r[0] for r in df.select(P.tolerant_bool("c")).collect()]
    assert vals == [1, 1, 0, 0, 0]
    t = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), (None,)], "p string")
    assert [r[0] for r in t.select(P.regex_capture("p", r"^1-(.+)$")).collect()] == ["URGENT", "Unknown", "Unknown"]


def test_first_token_and_number(spark):
    df = spark.createDataFrame([("  hot  ring",), ("",), (None,), ("solo",)], "c string")
    assert [r[0] for r in df.select(P.first_token("c")).collect()] == ["hot", None, None, "solo"]
    n = spark.createDataFrame([("12.5",), ("x",), (None,)], "c string")
    assert [r[0] for r in n.select(P.to_number("c")).collect()] == [12.5, None, None]


def test_rowwise_edge_rows(spark):
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(None, None, None), (0.0, 0.0, 0.0), (5.0, 5.0, 1.0), (1.0, None, 3.0)],
                               "a double, b double, c double")
    out = df.select(RW.row_sum(cols).alias("s"), RW.row_max(cols).alias("mx"), RW.argmax_name(cols).alias("am"),
                    RW.row_var(cols).alias("v"), RW.row_median(cols).alias("md"), RW.row_skew(cols).alias("sk"),
                    RW.positive_count(cols).alias("np")).collect()
    assert out[0]["s"] == 0.0 and out[0]["mx"] is None and out[0]["am"] == "a" and out[0]["md"] is None
    assert out[1]["am"] == "a" and out[1]["sk"] == 0.0                      # all-zero row -> first; constant -> 0
    assert out[2]["am"] == "a" and out[2]["np"] == 3                        # two equal maxima -> first
    assert out[3]["s"] == 4.0 and out[3]["md"] == 2.0 and out[3]["v"] == 2.0  # NULL skipped
    assert out[3]["sk"] is None                                             # fewer than three values
    # adjusted skewness agrees with the closed form for n = 3
    x = [5.0, 5.0, 1.0]
    m = sum(x) / 3
    m2 = sum((v - m) ** 2 for v in x) / 3
    m3 = sum((v - m) ** 3 for v in x) / 3
    expect = m3 / m2 ** 1.5 * math.sqrt(3 * 2) / 1
    assert abs(out[2]["sk"] - expect) < 1e-12


def test_map_and_combine(spark):
    df = spark.createDataFrame([("x", None), ("y", "B"), ("z", "C")], "a string, b string")
    out = df.select(P.combine(["a", "b"], "_", fill="nan").alias("c"),
                    P.map_values("b", {"B": 2.0}).alias("m")).collect()
    assert [r["c"] for r in out] == ["x_nan", "y_B", "z_C"]
    assert [r["m"] for r in out] == [None, 2.0, None]
