"""Deterministic splits and folds (inventory N1-N5).

Seeded NumPy shuffles are replaced by md5 ordering, which is identical in any
engine. The exact position of a row in (strata, order..., md5) order is
computed without a single-partition window: rows are bucketed by a prefix of
the md5 hex string, a small (strata, bucket) count table gives each bucket's
offset, and ``row_number`` runs inside (strata, bucket) partitions only.
Ordering by (prefix, md5) equals ordering by md5, so the result is the same
as a global ``row_number() OVER (PARTITION BY strata ORDER BY md5)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join
from fitloom.operators.metrics import quantile_cuts, range_bucket

ORDER_RANGES = 64


def md5_of(*cols, salt: Column | None = None) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if salt is not None:
        parts.append(salt.cast("string"))
    expr = parts[0] if len(parts) == 1 else F.concat_ws("#", *parts)
    return F.md5(expr)


def ordered_position(df: DataFrame, hash_col: str, strata: Sequence[str] = (),
                     order: Sequence[str] = (), prefix_len: int = 4,
                     out: str = "pos", size_out: str | None = None, bucket: Column | None = None) -> DataFrame:
    """1-based position of each row in (order..., hash_col) order within its stratum.

    ``bucket`` must be monotone in ``hash_col`` (default: its first ``prefix_len``
    characters, which is monotone for strings)."""
    strata, order = list(strata), list(order)
    b = F.substring(F.col(hash_col), 1, prefix_len) if bucket is None else bucket
    d = df.withColumn("__b", b)
    keys = strata + order + ["__b"]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__op_n"))
    wpart = Window.partitionBy(*strata) if strata else Window.partitionBy()
    upto = (Window.unboundedPreceding, -1)
    if order:
        # the table of counts grows with the distinct ordering values: running counts inside ranges of the
        # first one, plus the few ranges' own, so that no task orders it whole
        counts = counts.withColumn("__rng", range_bucket(F.col(order[0]), quantile_cuts(d, order[0], ORDER_RANGES)))
        ranges = counts.groupBy(*strata, "__rng").agg(F.sum("__op_n").alias("__rn_n"))
        ranges = ranges.select(*strata, "__rng", F.sum("__rn_n").over(wpart).alias("__size"),
                               F.coalesce(F.sum("__rn_n").over(wpart.orderBy("__rng").rowsBetween(*upto)), F.lit(0)).alias("__before"))
        wrun = Window.partitionBy(*strata, "__rng").orderBy(*order, "__b").rowsBetween(*upto)
        offs = counts.withColumn("__in", F.coalesce(F.sum("__op_n").over(wrun), F.lit(0))).join(ranges, [*strata, "__rng"])
        offs = offs.select(*keys, (F.col("__before") + F.col("__in")).alias("__off"), "__size")
    else:
        offs = counts.select(*keys, F.coalesce(F.sum("__op_n").over(wpart.orderBy("__b").rowsBetween(*upto)), F.lit(0)).alias("__off"),
                             F.sum("__op_n").over(wpart).alias("__size"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(hash_col)))
    d = d.withColumn("__rn", local)
    # offsets share lineage with ``d``; AQE broadcasts them at runtime when small
    j = d.join(offs, keys, "inner")
    j = j.withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
    if size_out:
        j = j.withColumnRenamed("__size", size_out)
    return j.drop("__b", "__rn", "__off", "__size")


# N1 ---------------------------------------------------------------------------
def stratified_holdout(df: DataFrame, id_col: str, label: str, test_permille: int = 200,
                       out: str = "holdout") -> DataFrame:
    """First ceil(test share x class size) rows of each class in md5 order are held out."""
    d = df.withColumn("__h", md5_of(id_col))
    d = ordered_position(d, "__h", [label], size_out="__cls_n")
    hold = ((F.col("pos") - 1) * 1000 < F.col("__cls_n") * test_permille).cast("int")
    return d.withColumn(out, hold).drop("__h", "pos", "__cls_n")


# N2 ---------------------------------------------------------------------------
def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    d = ordered_position(df.withColumn("__h", md5_of(id_col)), "__h", [label])
    return d.withColumn(out, ((F.col("pos") - 1) % k).cast("int")).drop("__h", "pos")


# N5 ---------------------------------------------------------------------------
def kfold(df: DataFrame, id_col: str, k: int = 5, out: str = "fold") -> DataFrame:
    d = ordered_position(df.withColumn("__h", md5_of(id_col)), "__h", [])
    return d.withColumn(out, ((F.col("pos") - 1) % k).cast("int")).drop("__h", "pos")


# N4 ---------------------------------------------------------------------------
def repeated_stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, repeats: int = 3,
                              out: str = "fold") -> DataFrame:
    """One row per (row, repeat); each repeat orders rows by md5(id#repeat)."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("__h", md5_of(id_col, salt=F.col("repeat")))
    d = ordered_position(d, "__h", ["repeat", label])
    return d.withColumn(out, ((F.col("pos") - 1) % k).cast("int")).drop("__h", "pos")


# N3 ---------------------------------------------------------------------------
def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int = 5, out: str = "fold",
                           prefix_len: int = 2) -> DataFrame:
    """Groups never straddle folds; groups ordered by (positive rate, size, md5) and dealt in a snake."""
    g = (df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label)).alias("__p"))
           .withColumn("__rate", F.col("__p") / F.col("__n"))
           .withColumn("__h", md5_of(group)))
    g = ordered_position(g, "__h", [], order=["__rate", "__n"], prefix_len=prefix_len)
    p = F.col("pos") - 1
    cycle, r = F.floor(p / k), p % k
    fold = F.when(cycle % 2 == 0, r).otherwise(k - 1 - r).cast("int")
    table = g.select(group, fold.alias(out))
    return lookup_join(df, table, group, "left")


def assert_group_disjoint(df: DataFrame, group: str, fold: str = "fold") -> None:
    n = df.groupBy(group).agg(F.count_distinct(fold).alias("nf")).where("nf > 1").limit(1).count()
    if n:
        raise AssertionError("a group straddles folds")
