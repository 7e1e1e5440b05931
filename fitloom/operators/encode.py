"""Encoders fitted on training rows and applied to any rows (J1-J8), and scalers (K1-K2).

A fitted encoder is a small DataFrame keyed by category (or by category and
fold for out-of-fold encoders) attached with ``lookup_join``; global
statistics are one-row aggregates brought back as literals. K-fold encoders
use the subtraction identity: the encoding for fold f uses
(sum over all training rows - sum over fold f), so one pass of two aggregates
replaces k refits.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join, scalar_row



def category_key(col: str, nan_as_category: bool = False) -> Column:
    """The category as text; pandas ``astype(str)`` turns missing values into 'nan'."""
    c = F.col(col).cast("string")
    return F.coalesce(c, F.lit("nan")) if nan_as_category else c


def apply_lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default) -> DataFrame:
    t = table.select(F.col(key).alias("__lk_key"), F.col(value).alias("__lk_val"))
    j = lookup_join(df, t, F.col(key) == F.col("__lk_key"), "left")
    return j.withColumn(out, F.coalesce(F.col("__lk_val"), F.lit(default))).drop("__lk_key", "__lk_val")


# J1 ---------------------------------------------------------------------------
def fit_frequency(train: DataFrame, col: str, denominator: str = "all") -> tuple[DataFrame, int]:
    """Share of training rows per non-NULL value; denominator all rows or non-NULL rows."""
    tot = scalar_row(train.agg(F.count(F.lit(1)).alias("a"), F.count(F.col(col)).alias("b")))
    n = tot["a"] if denominator == "all" else tot["b"]
    t = (train.where(F.col(col).isNotNull()).groupBy(col)
         .agg((F.count(F.lit(1)) / F.lit(float(n))).alias("freq")))
    return t, n


# J2 / J5 ------------------------------------------------------------------------
def fit_target_stats(train: DataFrame, col: str, label: str, nan_as_category: bool = False) -> DataFrame:
    return (train.groupBy(category_key(col, nan_as_category).alias(col))
            .agg(F.sum(F.col(label).cast("double")).alias("sum_y"), F.count(F.lit(1)).alias("n"),
                 F.avg(F.col(label).cast("double")).alias("mean_y")))


def global_mean(train: DataFrame, label: str) -> float:
    return scalar_row(train.agg(F.avg(F.col(label).cast("double")).alias("g")))["g"]


def smoothed(sum_y: Column, n: Column, prior: float, m: float) -> Column:
    return (sum_y + F.lit(m * prior)) / (n + F.lit(float(m)))


def fit_smoothed_target(train: DataFrame, col: str, label: str, smoothing: float = 10.0,
                        nan_as_category: bool = False) -> tuple[DataFrame, float]:
    g = global_mean(train, label)
    st = fit_target_stats(train, col, label, nan_as_category)
    return st.select(col, smoothed(F.col("sum_y"), F.col("n"), g, smoothing).alias("enc")), g


# J3 / J4 ------------------------------------------------------------------------
def oof_target_encode(train: DataFrame, col: str, label: str, fold: str, out: str,
                      smoothing: float = 10.0, prior: float | None = None) -> DataFrame:
    """Out-of-fold encoding: each training row only sees labels from the other folds.

    Unseen-in-other-folds and NULL categories get the prior (global training mean).
    ``smoothing=0`` gives the plain out-of-fold mean.
    """
    g = global_mean(train, label) if prior is None else prior
    y = F.col(label).cast("double")
    per_fold = train.groupBy(col, fold).agg(F.sum(y).alias("__sf"), F.count(F.lit(1)).alias("__nf"))
    total = train.groupBy(col).agg(F.sum(y).alias("__sa"), F.count(F.lit(1)).alias("__na"))
    t = per_fold.join(total, col)
    rest_n = F.col("__na") - F.col("__nf")
    rest_s = F.col("__sa") - F.col("__sf")
    enc = F.when(rest_n > 0, smoothed(rest_s, rest_n, g, smoothing))
    t = t.where(F.col(col).isNotNull()).select(col, fold, enc.alias("__enc"))
    j = lookup_join(train, t, [col, fold], "left")
    return j.withColumn(out, F.coalesce(F.col("__enc"), F.lit(g))).drop("__enc")


# J6 ---------------------------------------------------------------------------
def fit_sigmoid_target(train: DataFrame, col: str, label: str, smoothing: float = 0.2,
                       min_samples_leaf: int = 20) -> tuple[DataFrame, float]:
    """Blend of category mean and prior weighted by 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))."""
    g = global_mean(train, label)
    st = fit_target_stats(train, col, label)
    w = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    enc = F.lit(g) * (1 - w) + F.col("mean_y") * w
    return st.where(F.col(col).isNotNull()).select(col, enc.alias("enc")), g


def oof_sigmoid_target(train: DataFrame, col: str, label: str, fold: str, out: str, smoothing: float = 0.2,
                       min_samples_leaf: int = 20) -> DataFrame:
    """Sigmoid-weighted target encoding in which a row sees the other folds only; their mean is the prior.

    Counts and sums per (category, fold) and per fold, taken off the totals: no fit per fold.
    """
    y = F.col(label).cast("double")
    sums = [F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")]
    per = train.where(F.col(col).isNotNull()).groupBy(col, fold).agg(*sums)
    every = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(y).alias("__sa"), F.count(F.lit(1)).alias("__na"))
    total = train.agg(F.sum(y).alias("__st"), F.count(F.lit(1)).alias("__nt"))
    prior = (train.groupBy(fold).agg(*sums).crossJoin(F.broadcast(total))       # one row of totals
             .select(fold, F.try_divide(F.col("__st") - F.col("s"), F.col("__nt") - F.col("n")).alias("__prior")))
    n, mean = F.col("__na") - F.col("n"), F.try_divide(F.col("__sa") - F.col("s"), F.col("__na") - F.col("n"))
    w = 1.0 / (1.0 + F.exp(-(n - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    table = per.join(every, col).select(col, fold, F.when(n > 0, mean).alias("__mean"), F.when(n > 0, w).otherwise(0.0).alias("__w"))
    j = lookup_join(lookup_join(train, prior, fold, "left"), table, [col, fold], "left")
    w, mean = F.coalesce("__w", F.lit(0.0)), F.coalesce("__mean", F.lit(0.0))
    return j.withColumn(out, F.col("__prior") * (1 - w) + mean * w).drop("__prior", "__mean", "__w")


# J7 ---------------------------------------------------------------------------
def fit_categories(train: DataFrame, col: str, max_categories: int | None = None) -> list:
    """Sorted distinct non-NULL values: one column each, so their number is the caller's choice of feature.

    ``max_categories`` raises beyond the caller's own bound; there is no built-in one.
    """
    d = train.where(F.col(col).isNotNull()).select(col).distinct()
    if max_categories is not None and d.limit(max_categories + 1).count() > max_categories:
        raise ValueError(f"{col}: more than {max_categories} categories for one-hot encoding")
    return sorted(r[0] for r in d.collect())


def one_hot(df: DataFrame, col: str, categories: Sequence, drop_first: bool = True,
            prefix: str | None = None) -> DataFrame:
    """0/1 column per fitted category (first sorted one dropped); unseen and NULL -> all zeros."""
    prefix = prefix or col
    cats = list(categories)[1:] if drop_first else list(categories)
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int")
                           for v in cats})


# J8 ---------------------------------------------------------------------------
def fit_ordinal(frame: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Sorted codes 0..n-1 over the distinct non-NULL values (fit on train or on the union).

    The code is the position of the value among the distinct values, computed
    inside monotone value buckets (string prefixes, or approximate quantile
    ranges for numbers) with per-bucket offsets, so a high-cardinality column
    is not ranked in one task.
    """
    from pyspark.sql import types as T

    from fitloom.operators.folds import ordered_position

    d = frame.where(F.col(col).isNotNull()).select(col).distinct()
    if isinstance(frame.schema[col].dataType, T.StringType):
        # values between the least and the greatest share their common prefix: bucket by what follows it
        ends = d.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        common = len(os.path.commonprefix([ends["lo"] or "", ends["hi"] or ""]))
        bucket = F.substring(F.col(col), 1, common + 3)
    else:
        edges = d.agg(F.percentile_approx(F.col(col).cast("double"), [i / buckets for i in range(1, buckets)],
                                          10 * buckets).alias("e")).first()["e"] or []
        edges = sorted(set(edges))
        bucket = (F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(col).cast("double")))
                  if edges else F.lit(0))
    pos = ordered_position(d, col, bucket=bucket, out="__pos")
    return pos.select(col, (F.col("__pos") - 1).cast("int").alias("code"))


def apply_ordinal(df: DataFrame, table: DataFrame, col: str, out: str) -> DataFrame:
    return apply_lookup(df, table, col, "code", out, -1)


# K1 ---------------------------------------------------------------------------
def fit_standard(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column; a zero std scales by 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    r = scalar_row(train.agg(*aggs))
    return {c: (r[f"{c}__m"], r[f"{c}__s"] if r[f"{c}__s"] not in (None, 0.0) else 1.0) for c in cols}


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# K2 ---------------------------------------------------------------------------
def fit_robust(train: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float]]:
    """Median and inter-quartile range per column; a zero range scales by 1."""
    from fitloom.functions.quantiles import exact_quantiles_multi

    if exact:
        r = exact_quantiles_multi(train, cols, [0.25, 0.5, 0.75])
    else:
        arr = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        r = scalar_row(train.agg(*[F.percentile_approx(c, arr, 100_000).alias(c) for c in cols]))
    out = {}
    for c in cols:
        q1, med, q3 = r[c]
        iqr = q3 - q1
        out[c] = (med, iqr if iqr != 0 else 1.0)
    return out
