"""Blending over a long prediction table P = (row_id, member, prob, vote).

Each blend is one ``groupBy(row_id)`` aggregate (partial aggregation, no
member x row matrix in memory). Averaged probabilities are rounded to
``PREC`` decimals before any threshold comparison so a result does not
depend on the order in which partitions were summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join

PREC = 12


def _lit_map(mapping: Mapping[int, float]) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(int(k)), F.lit(float(v))]
    return F.create_map(*items)


def _cmp(x: Column, t: float, strict: bool) -> Column:
    return (x > t) if strict else (x >= t)


# P5 ---------------------------------------------------------------------------
def average_blend(P: DataFrame, threshold: float = 0.5, strict: bool = True) -> DataFrame:
    m = F.round(F.avg("prob"), PREC)
    return P.groupBy("row_id").agg(m.alias("prob_mean")).withColumn(
        "pred", _cmp(F.col("prob_mean"), threshold, strict).cast("int"))


# P6 ---------------------------------------------------------------------------
def weighted_blend(P: DataFrame, weights: Mapping[int, float], threshold: float = 0.5) -> DataFrame:
    """Soft vote sum(w * p) / sum(w) with member weights given as a literal map (no join)."""
    w = F.try_element_at(_lit_map(weights), F.col("member"))
    agg = F.round(F.sum(w * F.col("prob")) / F.sum(w), PREC)
    return P.groupBy("row_id").agg(agg.alias("prob_w")).withColumn(
        "pred", (F.col("prob_w") > threshold).cast("int"))


# P7 / P13 -----------------------------------------------------------------------
def majority_vote(P: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    share = F.round(F.avg(F.col("vote").cast("double")), PREC)
    return P.groupBy("row_id").agg(share.alias("vote_share")).withColumn(
        "pred", _cmp(F.col("vote_share"), threshold, strict).cast("int"))


def majority_of(frames: Sequence[DataFrame], vote: str = "vote", key: str = "row_id",
                strict: bool = True) -> DataFrame:
    """Majority over several prediction sets (files) unioned with a member id."""
    u = None
    for i, f in enumerate(frames):
        part = f.select(F.col(key).alias("row_id"), F.lit(i).alias("member"), F.col(vote).cast("int").alias("vote"))
        u = part if u is None else u.unionByName(part)
    return majority_vote(u, 0.5, strict)


# P8 ---------------------------------------------------------------------------
def score_weighted(P: DataFrame, scores: Mapping[int, float]) -> DataFrame:
    """Average with weights = member score / sum of scores (normalised on the driver)."""
    tot = sum(scores.values())
    return weighted_blend(P, {m: s / tot for m, s in scores.items()})


# P9 ---------------------------------------------------------------------------
def confidence_vote(P: DataFrame) -> DataFrame:
    """sum over members of sign(p - 0.5) * 2|p - 0.5|; positive -> 1 (p = 0.5 counts as negative, weight 0)."""
    conf = F.abs(F.col("prob") - 0.5) * 2
    signed = F.when(F.col("prob") > 0.5, conf).otherwise(-conf)
    return P.groupBy("row_id").agg((F.round(F.sum(signed), PREC) + 0.0).alias("conf_score")).withColumn(
        "pred", (F.col("conf_score") > 0).cast("int"))


# P10 --------------------------------------------------------------------------
def hybrid_blend(P: DataFrame, hi: float = 0.8, lo: float = 0.2) -> DataFrame:
    """Strong agreement (share >= hi or <= lo) -> majority vote, otherwise mean probability."""
    agg = P.groupBy("row_id").agg(F.round(F.avg(F.col("vote").cast("double")), PREC).alias("agreement"),
                                  F.round(F.avg("prob"), PREC).alias("prob_mean"))
    strong = (F.col("agreement") >= hi) | (F.col("agreement") <= lo)
    return agg.select("row_id", "agreement", "prob_mean",
                      F.when(strong, F.lit("vote")).otherwise(F.lit("average")).alias("branch"),
                      F.when(strong, F.col("agreement") >= 0.5).otherwise(F.col("prob_mean") >= 0.5)
                      .cast("int").alias("pred"))


def branch_counts(h: DataFrame) -> DataFrame:
    return h.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


# P11 --------------------------------------------------------------------------
def member_deviation(P: DataFrame) -> DataFrame:
    """Mean |vote - consensus| per member, consensus = mean vote of the row."""
    cons = P.groupBy("row_id").agg(F.avg(F.col("vote").cast("double")).alias("__c"))
    j = P.join(cons, "row_id")
    return j.groupBy("member").agg(F.round(F.avg(F.abs(F.col("vote") - F.col("__c"))), PREC).alias("deviation"))


def prune_and_vote(P: DataFrame, keep_n: int) -> DataFrame:
    dev = member_deviation(P)
    kept = dev.withColumn("__rk", F.row_number().over(Window.orderBy("deviation", "member"))).where(
        F.col("__rk") <= keep_n).select("member")
    return majority_vote(lookup_join(P, kept, "member", "inner"), 0.5, strict=False)


# P18 --------------------------------------------------------------------------
def fold_average(P: DataFrame, k: int, key: str = "row_id") -> DataFrame:
    """Test probability averaged over k fold models: sum(p) / k."""
    return P.groupBy(key).agg(F.round(F.sum("prob") / k, PREC).alias("prob_fold_avg"))


def to_wide(P: DataFrame, members: Sequence[int], key: str = "row_id", value: str = "prob") -> DataFrame:
    """Long member table -> one column per member (one aggregate)."""
    return P.groupBy(key).agg(*[F.max(F.when(F.col("member") == m, F.col(value))).alias(f"p{m}") for m in members])
