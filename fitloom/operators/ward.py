"""Hierarchical segments by Ward's criterion over clustering features.

Rows are standardised and summed up in one aggregate into clustering features: (count, sum, sum of squares)
per cell of an even grid with at most ``most`` cells, or per distinct row where there are no more than that.
Ward's merges run over this bounded table (nearest-neighbour chains: most^2 steps of arithmetic), with the
cost of joining two features n_a * n_b / (n_a + n_b) * |mean_a - mean_b|^2, which is exact for the rows they sum up.
Every row is labelled by its cell; a row of a cell that no training row lies in goes to the nearest segment mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators.cluster import nearest_centroid
from fitloom.operators.encode import fit_standard


def ward_merges(count: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, cost) in the order of their cost; a merge keeps the lower of the two numbers.

    Chains of nearest neighbours end in pairs that are each other's nearest; Ward's cost never falls by a
    merge, so pairs may be merged as they are found and put in order afterwards.
    """
    count, mean = count.astype(float).copy(), mean.astype(float).copy()
    alive = np.ones(len(count), bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        at = chain[-1]
        cost = count * count[at] / (count + count[at]) * ((mean - mean[at]) ** 2).sum(axis=1)
        cost[~alive] = np.inf
        cost[at] = np.inf
        best = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[best]:
            best = chain[-2]
        if len(chain) > 1 and best == chain[-2]:
            a, b = sorted((at, best))
            merges.append((a, b, float(cost[best])))
            mean[a] = (mean[a] * count[a] + mean[b] * count[b]) / (count[a] + count[b])
            count[a] += count[b]
            alive[b] = False
            chain = chain[:-2]
        else:
            chain.append(best)
    # found order is a stable tie-break: a merge comes after those that made its parts
    return sorted(merges, key=lambda m: m[2])


def cut(n: int, merges: Sequence[tuple[int, int, float]], k: int) -> np.ndarray:
    """Segment (from 0, by least member) of every feature once k are left."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in merges[:max(0, n - k)]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = [find(x) for x in range(n)]
    number = {r: i for i, r in enumerate(sorted(set(found)))}
    return np.array([number[r] for r in found], np.int64)


class WardSegments:
    """Fitted segments: cells with their label, and the means of the segments."""

    def __init__(self, cell: Column, table: DataFrame, scaled: dict[str, Column], centres: list[list[float]], merges: list):
        self.cell, self.table, self.scaled, self.centres, self.merges = cell, table, scaled, centres, merges

    def label(self, df: DataFrame, out: str = "segment") -> DataFrame:
        """``df`` with its segment: that of its cell (the table has at most ``most`` rows), else the nearest mean."""
        rows = df.withColumn("__cell", self.cell).join(F.broadcast(self.table), "__cell", "left").withColumns(self.scaled)
        near = nearest_centroid(list(self.scaled), self.centres)
        return rows.withColumn(out, F.coalesce("__segment", near).cast("int")).drop("__cell", "__segment", *self.scaled)


def fit_ward(spark: SparkSession, train: DataFrame, features: Sequence[str], k: int = 12, most: int = 2000) -> WardSegments:
    """Fit ``k`` Ward segments on standardised ``features`` (NULL as the mean)."""
    params = fit_standard(train, features)
    scaled = {f"__z{i}": F.coalesce((F.col(f) - F.lit(params[f][0])) / F.lit(params[f][1]), F.lit(0.0)) for i, f in enumerate(features)}
    rows = train.select(*[c.alias(n) for n, c in scaled.items()])
    if rows.distinct().limit(most + 1).count() <= most:
        cell = F.concat_ws("|", *[c.cast("string") for c in scaled.values()])
    else:
        sides = max(1, int(most ** (1.0 / len(features))))
        ends = rows.agg(*[F.min(n).alias(f"l{n}") for n in scaled], *[F.max(n).alias(f"h{n}") for n in scaled]).first()
        place = []
        for n, c in scaled.items():
            low, span = ends[f"l{n}"], ends[f"h{n}"] - ends[f"l{n}"]
            place.append(F.greatest(F.lit(0), F.least(F.lit(sides - 1), F.floor((c - F.lit(low)) / F.lit(span or 1.0) * sides))).cast("string"))
        cell = F.concat_ws("|", *place)
    sums = train.withColumn("__cell", cell).withColumns(scaled).groupBy("__cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in scaled], F.sum(sum(F.col(n) * F.col(n) for n in scaled)).alias("ss"))
    cells = sorted(sums.collect(), key=lambda r: r["__cell"])                    # at most `most` rows
    if not cells:
        raise ValueError("no rows to fit on")
    count = np.array([r["n"] for r in cells], float)
    mean = np.round(np.array([[r[n] for n in scaled] for r in cells]) / count[:, None], 12)
    merges = ward_merges(count, mean)
    segment = cut(len(cells), merges, k)
    table = spark.createDataFrame([(r["__cell"], int(s)) for r, s in zip(cells, segment, strict=True)], "__cell string, __segment int")
    centres = [(mean[segment == s] * count[segment == s, None]).sum(axis=0) / count[segment == s].sum() for s in range(segment.max() + 1)]
    return WardSegments(cell, table, scaled, [c.tolist() for c in centres], merges)
