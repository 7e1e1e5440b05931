"""Group folds balanced by a greedy over group shapes.

A group's shape is its number of positive and negative rows. From the most one-sided and largest shape on,
each group goes to the fold where it adds least to the variance of the folds' class shares (sum over both
classes; ties: fewest rows, then the lower fold). Groups of one shape are interchangeable and raise any
fold's score by the same step, so all but the last few of them are placed at once by filling the folds up
to a common level. Groups are then dealt by their place (md5 order) among the groups of their shape, a
distributed ranking.

One row per shape reaches the driver: R rows have at most about R^(2/3) distinct shapes, some thousands in
practice, however many groups there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join
from fitloom.operators.folds import md5_of, ordered_position


def _level(scores: list[float], step: float, m: int) -> list[int]:
    """How many of the next ``m`` equal groups every fold takes for sure: those below the highest level that ``m`` groups reach."""
    low, high = min(scores), max(scores) + m * step
    for _ in range(200):
        mid = (low + high) / 2
        if sum(max(0, int((mid - s) / step)) for s in scores) <= m:
            low = mid
        else:
            high = mid
    return [max(0, int((low - s) / step) - 2) for s in scores]


def deal_shapes(shapes: Sequence[tuple[int, int, int]], k: int) -> dict[tuple[int, int], list[int]]:
    """Per shape (positives, negatives, m): how many of its m groups each fold gets."""
    pos_all, neg_all = sum(p * m for p, _, m in shapes), sum(n * m for _, n, m in shapes)
    pos, neg, out = [0] * k, [0] * k, {}
    for p, n, m in sorted(shapes, key=lambda s: (-abs(s[0] - s[1]), -(s[0] + s[1]), -s[0])):
        # adding (p, n) to fold f raises the variance by an amount that differs between folds only in this
        by_pos, by_neg = p / pos_all**2 if pos_all else 0.0, n / neg_all**2 if neg_all else 0.0
        step = p * by_pos + n * by_neg
        took = _level([pos[f] * by_pos + neg[f] * by_neg for f in range(k)], step, m) if m > 8 * k and step > 0 else [0] * k
        for f in range(k):
            pos[f] += took[f] * p
            neg[f] += took[f] * n
        for _ in range(m - sum(took)):
            f = min(range(k), key=lambda f: (pos[f] * by_pos + neg[f] * by_neg, pos[f] + neg[f], f))
            pos[f] += p
            neg[f] += n
            took[f] += 1
        out[p, n] = took
    return out


def balanced_group_kfold(spark: SparkSession, df: DataFrame, group: str, label: str, k: int = 5, out: str = "fold",
                         prefix_len: int = 2) -> DataFrame:
    """No group straddles folds, and the folds' class shares vary as little as the greedy can do."""
    positive = F.coalesce(F.col(label).cast("long"), F.lit(0))
    g = df.groupBy(group).agg(F.sum(positive).alias("__p"), F.sum(1 - positive).alias("__n")).withColumn("__h", md5_of(group))
    shapes = g.groupBy("__p", "__n").agg(F.count(F.lit(1)).alias("m"))
    dealt = deal_shapes([(r["__p"], r["__n"], r["m"]) for r in shapes.collect()], k)
    upto = [(p, n, [sum(took[:f + 1]) for f in range(k)]) for (p, n), took in dealt.items()]
    borders = spark.createDataFrame(upto, "__p long, __n long, __upto array<long>")
    placed = ordered_position(g, "__h", ["__p", "__n"], prefix_len=prefix_len)
    fold = F.size(F.filter("__upto", lambda u: u < F.col("pos"))).cast("int")
    table = placed.join(borders, ["__p", "__n"]).select(group, fold.alias(out))
    return lookup_join(df, table, group, "left")
