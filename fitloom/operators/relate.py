"""Joins (H1-H5), set operations (I1-I3) and ordering / top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join


# H1 ---------------------------------------------------------------------------
def attach(df: DataFrame, stats: DataFrame, on, how: str = "left") -> DataFrame:
    """Left equi-join of a statistics table (broadcast only within the checked bound)."""
    return lookup_join(df, stats, on, how)


# H2 ---------------------------------------------------------------------------
def lookup_with_default(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default) -> DataFrame:
    from fitloom.operators.encode import apply_lookup

    return apply_lookup(df, table, key, value, out, default)


# H3 ---------------------------------------------------------------------------
def hconcat(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Key-aligned horizontal concatenation of feature blocks (inner join on the key)."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key, "inner")
    return out


# H4 ---------------------------------------------------------------------------
def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Reorder to the training column list; missing -> ``fill``; extra columns dropped."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(fill).alias(c) for c in columns])


# H5 ---------------------------------------------------------------------------
def compare_predictions(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """How many rows differ between two prediction sets (joined on the key)."""
    j = a.select(key, F.col(col).alias("__a")).join(b.select(key, F.col(col).alias("__b")), key, "inner")
    return j.agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_diff"),
                 F.count(F.lit(1)).alias("n_rows"))


# I1 ---------------------------------------------------------------------------
def union_with_provenance(train: DataFrame, test: DataFrame, col: str = "split") -> DataFrame:
    """Stack train and test (test lacks the label -> NULL) with a provenance column."""
    return (train.withColumn(col, F.lit("train"))
            .unionByName(test.withColumn(col, F.lit("test")), allowMissingColumns=True))


def split_back(df: DataFrame, col: str = "split") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(col) == "train").drop(col), df.where(F.col(col) == "test").drop(col)


# I2 ---------------------------------------------------------------------------
def add_pseudo_labels(labelled: DataFrame, scored: DataFrame, prob: str, label: str,
                      hi: float = 0.9, lo: float | None = 0.1, min_rows: int = 0) -> DataFrame:
    """Union labelled rows with confidently scored rows (p >= hi -> 1, p <= lo -> 0).

    The reference's rule: they are used only if there are more than ``min_rows`` of them.
    """
    conf = F.col(prob) >= hi
    if lo is not None:
        conf = conf | (F.col(prob) <= lo)
    pseudo = (scored.where(conf).withColumn(label, (F.col(prob) >= hi).cast("int"))
              .drop(prob).withColumn("is_pseudo", F.lit(1)))
    if min_rows and pseudo.limit(min_rows + 1).count() <= min_rows:
        pseudo = pseudo.limit(0)
    return labelled.withColumn("is_pseudo", F.lit(0)).unionByName(pseudo, allowMissingColumns=True)


# I3 ---------------------------------------------------------------------------
def category_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).where(F.col(col).isNotNull()).distinct()


# T1 / T2 ------------------------------------------------------------------------
def top_n(df: DataFrame, by: str, n: int, tie: str | None = None) -> DataFrame:
    """Top-n by ``by`` descending (ties broken by ``tie`` ascending): a TakeOrdered, no full sort."""
    order = [F.col(by).desc()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(n)


def top_n_names(df: DataFrame, name: str, by: str, n: int) -> list[str]:
    return [r[0] for r in top_n(df, by, n, name).select(name).collect()]


# T3 ---------------------------------------------------------------------------
def keep_smallest(df: DataFrame, by: str, n: int, tie: str, partition: Sequence[str] = ()) -> DataFrame:
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(F.col(by), F.col(tie))
    return df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n).drop("__rk")


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")
