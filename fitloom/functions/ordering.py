"""Places of rows in an order over all partitions, without a task that sorts them all.

Rows are dealt to partitions by range, sorted there and written with a number that increases in that
order; counts per block of numbers give the offsets. A group with a third of all rows is spread over as
many blocks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.session import keep_for_reuse

BLOCK = 4096
BEFORE = (Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "at") -> DataFrame:
    """``df`` with a number (with gaps) that increases in ``order``; written once to the shared folder."""
    return keep_for_reuse(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))


def running(df: DataFrame, group: Sequence[str], at: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including each row, in the order of ``at``."""
    group = list(group)
    d = df.withColumn("__block", F.floor(F.col(at) / block)).withColumn("__v", value)
    before = d.groupBy(*group, "__block").agg(F.sum("__v").alias("__s")).select(
        *group, "__block", F.coalesce(F.sum("__s").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(*BEFORE)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*group, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__in", F.sum("__v").over(inner)).join(before, [*group, "__block"])
    return d.withColumn(out, F.col("__before") + F.col("__in")).drop("__block", "__v", "__in", "__before")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", block: int = BLOCK) -> DataFrame:
    """Place (from 0) of each row within its group in ``order``; rows that tie take any order among them."""
    d = numbered(df, [*group, *order], "__at")
    return running(d, group, "__at", F.lit(1), out, block).withColumn(out, F.col(out) - 1).drop("__at")
