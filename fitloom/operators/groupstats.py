"""Grouped aggregation (F1-F10) and group-broadcast features.

Group statistics are computed with ``groupBy().agg()`` (partial aggregation
before the shuffle, so a hot key costs one map-side combine, not a hot
reducer) and attached back with ``lookup_join``: broadcast when the stats
table is within the checked bound, otherwise a shuffle join that AQE's
skew-join splits. Ordered per-group ranks first collapse rows to
(group, value) counts so that a hot group is ranked over its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join
from fitloom.functions.quantiles import group_quantiles

STAT_FUNCS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "sum": F.sum, "count": F.count, "median": F.median, "var": F.var_samp,
}


# F1 ---------------------------------------------------------------------------
def group_agg(df: DataFrame, by, spec: dict[str, Sequence[str]], decimals: int | None = None,
              fill_null: float | None = 0.0) -> DataFrame:
    """Multi-column multi-stat aggregate with flattened ``<col>_<stat>`` names."""
    by = [by] if isinstance(by, str) else list(by)
    exprs = []
    for col, stats in spec.items():
        for s in stats:
            e = STAT_FUNCS[s](F.col(col))
            if s != "count":
                if decimals is not None:
                    e = F.bround(e, decimals)   # half to even, as the reference rounds
                if fill_null is not None:
                    e = F.coalesce(e, F.lit(fill_null))
            exprs.append(e.alias(f"{col}_{s}"))
    return df.groupBy(*by).agg(*exprs)


# F2 ---------------------------------------------------------------------------
def value_share(df: DataFrame, col: str, denominator: str = "all") -> DataFrame:
    """Counts and share per non-NULL value; denominator 'all' rows or 'nonnull' rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.col(col)).alias("n_nonnull")).first()
    denom = tot["n_all"] if denominator == "all" else tot["n_nonnull"]
    return counts.withColumn("share", F.col("n") / F.lit(float(denom)) if denom else F.lit(None).cast("double"))


# F3 ---------------------------------------------------------------------------
def distinct_counts(df: DataFrame, cols: Sequence[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    f = (lambda c: F.count_distinct(F.col(c))) if exact else (lambda c: F.approx_count_distinct(c, rsd))
    return df.agg(*[f(c).alias(f"{c}_nunique") for c in cols])


# F4 ---------------------------------------------------------------------------
def label_rate(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.groupBy(col).agg(F.avg(label).alias("label_mean"), F.count(F.lit(1)).alias("n"))


# F5 ---------------------------------------------------------------------------
def filtered_median(df: DataFrame, cond: Column, by: str, col: str, exact: bool = True) -> DataFrame:
    if exact:
        return group_quantiles(df.where(cond), by, col, [0.5], [f"{col}_median"])
    return df.where(cond).groupBy(by).agg(F.percentile_approx(col, 0.5, 100_000).alias(f"{col}_median"))


# F6 ---------------------------------------------------------------------------
def group_mode(df: DataFrame, by, col: str, out: str | None = None) -> DataFrame:
    """Most frequent non-NULL value per group; ties -> smallest value; all-NULL -> NULL.

    Done as a (group, value) count aggregate followed by ``max_by`` over a
    (count, -rank) key, which keeps every step a partial aggregate.
    """
    by = [by] if isinstance(by, str) else list(by)
    out = out or f"{col}_mode"
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    # max count first, then the smallest value: order key (n, value) with value descending
    best = counts.groupBy(*by).agg(
        F.min_by(F.col(col), F.struct((-F.col("__n")).alias("a"), F.col(col).alias("b"))).alias(out))
    keys = df.select(*by).distinct()
    return keys.join(best, by, "left")


# F7 ---------------------------------------------------------------------------
def column_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance of every column in one pass, returned long (feature, variance)."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, variance)")


# F8 ---------------------------------------------------------------------------
def abs_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper-triangle |Pearson| for every column pair, one aggregate, returned long."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"{i}")
                    for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) as (feature_a, feature_b, abs_corr)")


# F9 ---------------------------------------------------------------------------
def prediction_distribution(preds: DataFrame, by: str = "member", vote: str = "vote") -> DataFrame:
    return preds.groupBy(by).agg(
        F.count_if(F.col(vote) == 0).alias("n_neg"),
        F.count_if(F.col(vote) == 1).alias("n_pos"),
        F.avg(F.col(vote).cast("double")).alias("pos_rate"))


# F10 --------------------------------------------------------------------------
def member_summary(preds: DataFrame, by: str = "row_id", prob: str = "prob") -> DataFrame:
    """Mean / population std / min / max of member scores per row (NumPy std is ddof=0)."""
    return preds.groupBy(by).agg(
        F.avg(prob).alias("prob_mean"), F.stddev_pop(prob).alias("prob_std"),
        F.min(prob).alias("prob_min"), F.max(prob).alias("prob_max"))


# G1-G2, G4-G7, G9-G10 ----------------------------------------------------------
def attach_group_stats(df: DataFrame, by, spec: dict[str, Sequence[str]], prefix: str = "g",
                       std_fill: float | None = 0.0, exact_median: bool = True) -> DataFrame:
    """Broadcast group statistics back to rows (pandas ``groupby.transform``).

    ``spec`` maps a column (or '*' for the row count) to stats among mean,
    std, min, max, sum, count, median, var, nunique1 (exactly one distinct value).
    """
    by = [by] if isinstance(by, str) else list(by)
    exprs, medians = [], []
    for col, stats in spec.items():
        for s in stats:
            name = f"{prefix}_{'size' if col == '*' else col + '_' + s}"
            if s == "median" and exact_median:
                medians.append((col, name))
                continue
            if col == "*":
                e = F.count(F.lit(1))
            elif s == "nunique1":
                # exactly one distinct non-NULL value <=> min = max: partial aggregates, no distinct sets
                e = F.coalesce(F.min(F.col(col)) == F.max(F.col(col)), F.lit(False)).cast("int")
            elif s == "median" and not exact_median:
                e = F.percentile_approx(F.col(col), 0.5, 100_000)
            else:
                e = STAT_FUNCS[s](F.col(col))
            if s in ("std", "var") and std_fill is not None:
                e = F.coalesce(e, F.lit(std_fill))
            exprs.append(e.alias(name))
    tables = [df.groupBy(*by).agg(*exprs)] if exprs else []
    # exact medians: rank ranges over (group, value) counts, no per-group value sets in one task
    tables += [group_quantiles(df, by, col, [0.5], [name]) for col, name in medians]
    stats = tables[0]
    for t in tables[1:]:
        stats = stats.join(t, by, "full")
    return lookup_join(df, stats, by, "left")


def group_size(df: DataFrame, by, out: str = "g_size") -> DataFrame:
    return attach_group_stats(df, by, {"*": ["count"]}).withColumnRenamed("g_size", out)


# G3 ---------------------------------------------------------------------------
def group_avg_rank(df: DataFrame, by, col: str, out: str | None = None, buckets: int = 128) -> DataFrame:
    """Average rank (ties share the mean of their positions) of ``col`` within its group.

    Rows collapse to (group, value, n). Values are cut into ``buckets`` ranges by
    approximate global quantile edges (any monotone cut keeps the order), so
    the running count runs inside (group, bucket) partitions and a hot group is
    spread over many tasks; each bucket's offset comes from a small (group,
    bucket) count table. avg rank = rows below + (n + 1) / 2.
    """
    by = [by] if isinstance(by, str) else list(by)
    out = out or f"{col}_grank"
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    probs = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(col, probs, 10 * buckets).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    bucket = F.lit(0)
    if edges:
        arr = F.array(*[F.lit(float(e)) for e in edges])
        bucket = F.size(F.filter(arr, lambda e: e < F.col(col)))
    counts = counts.withColumn("__b", bucket)
    bt = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*by, "__b", F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__off"))
    w = Window.partitionBy(*by, "__b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    ranks = local.join(bt, by + ["__b"]).select(
        *by, col, (F.col("__off") + F.col("__below") + (F.col("__n") + 1) / 2.0).alias(out))
    return lookup_join(df, ranks, by + [col], "left")


# G8 ---------------------------------------------------------------------------
def category_mean(df: DataFrame, key: str, col: str, out: str | None = None) -> DataFrame:
    """Mean of ``col`` per (non-key) category; NULL category -> global mean; plus deviation."""
    out = out or f"{col}_by_{key}"
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(col).alias(out))
    glob = df.agg(F.avg(col).alias("g")).first()["g"]
    j = lookup_join(df, stats, key, "left")
    return (j.withColumn(out, F.coalesce(F.col(out), F.lit(glob)))
             .withColumn(f"{out}_dev", F.col(col) - F.col(out)))


# G10 --------------------------------------------------------------------------
def category_volume(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    out = out or f"{key}_volume"
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return lookup_join(df, stats, key, "left")
