"""Post-prediction rules (R1-R4), set-based.

Groups are disjoint, so the reference's per-group loops equal one group
aggregate joined back; children are never adults, so rule 3 does not depend
on the order in which children are visited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join


def rule_state(df: DataFrame, state: str, spend: str, prob: str, pred: str, out: str = "pred_r1",
               lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """State true, zero spend and an uncertain score (lo < p < hi) -> positive; counts every override."""
    hit = F.coalesce((F.col(state) == F.lit(True)) & (F.col(spend) == 0) & (F.col(prob) > lo) & (F.col(prob) < hi),
                     F.lit(False))
    return df.withColumns({out: F.when(hit, F.lit(True)).otherwise(F.col(pred)), "r1_override": hit.cast("int")})


def rule_group(df: DataFrame, group: str, prob: str, pred: str, out: str = "pred_r2",
               min_size: int = 2, max_size: int = 3, hi_share: float = 0.75, lo_share: float = 0.25,
               lo: float = 0.4, hi: float = 0.6) -> DataFrame:
    """R2: in groups of min..max rows with a strong majority, uncertain members follow it."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("__gs"), F.avg(F.col(pred).cast("double")).alias("__share"))
    d = lookup_join(df, g, group, "left")
    small = F.col("__gs").between(min_size, max_size)
    unc = (F.col(prob) > lo) & (F.col(prob) < hi)
    new = (F.when(small & unc & (F.col("__share") >= hi_share), F.lit(True))
           .when(small & unc & (F.col("__share") <= lo_share), F.lit(False))
           .otherwise(F.col(pred)))
    return d.withColumn(out, new).withColumn("r2_changed", (F.col(out) != F.col(pred)).cast("int")).drop("__gs", "__share")


def rule_child(df: DataFrame, group: str, age: str, pred: str, out: str = "pred_r3",
               child_age: float = 5, adult_age: float = 18, hi: float = 0.7, lo: float = 0.3) -> DataFrame:
    """A child in a group with adults follows a clear adult majority."""
    adults = (df.where(F.col(age) > adult_age).groupBy(group)
              .agg(F.avg(F.col(pred).cast("double")).alias("__adult"), F.count(F.lit(1)).alias("__na")))
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("__gs"))
    d = lookup_join(lookup_join(df, size, group, "left"), adults, group, "left")
    child = (F.col(age) < child_age) & (F.col("__gs") > 1) & F.col("__adult").isNotNull()
    new = (F.when(child & (F.col("__adult") > hi) & ~F.col(pred), F.lit(True))
           .when(child & (F.col("__adult") < lo) & F.col(pred), F.lit(False))
           .otherwise(F.col(pred)))
    return (d.withColumn(out, new).withColumn("r3_changed", (F.col(out) != F.col(pred)).cast("int"))
            .drop("__adult", "__na", "__gs"))


def correction_counts(df: DataFrame, base: str, final: str) -> DataFrame:
    """Overrides per rule and the share of predictions changed overall."""
    return df.agg(F.sum("r1_override").alias("n_r1"), F.sum("r2_changed").alias("n_r2"),
                  F.sum("r3_changed").alias("n_r3"),
                  F.count_if(F.col(base) != F.col(final)).alias("n_changed"),
                  F.round(F.count_if(F.col(base) != F.col(final)) * 100.0 / F.count(F.lit(1)), 12).alias("pct_changed"))
