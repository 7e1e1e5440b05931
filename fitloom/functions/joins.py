"""Joins of fitted tables onto row-level data.

A fitted table is the output of an aggregate keyed by a category, bin, cluster
or group; grouped by an order or a customer it is as large as the data. The join
is left to adaptive execution, which knows the table's real size in bytes once
its aggregate has run: within Spark's broadcast threshold it is broadcast, beyond
it a shuffle join splits the hot keys of the big side. Nothing is persisted or
counted for it. A size that the caller has counted anyway can be passed in.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest fitted table (rows) that is broadcast. A fit table row is a key plus a
# handful of numbers, so this keeps the broadcast well below 100 MB.
BROADCAST_MAX_ROWS = 1_000_000
_CONF_KEY = "fitloom.broadcast.maxRows"


def broadcast_bound(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.conf.get(_CONF_KEY, str(BROADCAST_MAX_ROWS)))
    except Exception:
        return BROADCAST_MAX_ROWS


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist a fitted table once (it is applied to train and test) and count it."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                max_rows: int | None = None, counted: int | None = None) -> DataFrame:
    """Join a fitted table; the strategy is adaptive unless a ``counted`` size allows a broadcast."""
    if counted is not None and counted <= (broadcast_bound(big) if max_rows is None else max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)


def scalar_row(df: DataFrame) -> dict:
    """Collect a one-row fitted table (global statistics) as driver-side literals."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row of global statistics, got {len(rows)}")
    return rows[0].asDict()


def lit_or_null(v) -> Column:
    return F.lit(v)
