"""Silhouette in squared Euclidean distance over whole tables, for many clusterings of the same rows in two passes."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squared_silhouettes(rows: DataFrame, width: int) -> list[float]:
    """Silhouette by squared Euclidean distances over all rows, one per clustering, as Spark's ``ClusteringEvaluator`` defines it.

    ``rows`` has ``width`` numbers, then a label (from 0) per clustering. Mean squared distances to a cluster follow from its
    count, sum and sum of squares, so one pass adds these up for all clusterings and one scores every row: tasks send sums only.
    """
    clusterings = len(rows.columns) - width

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = np.column_stack(cols[:width]).astype(float)
        return x, (x * x).sum(axis=1), [c.astype(np.int64) for c in cols[width:]]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, squares, labels = split(batch)
            for k, label in enumerate(labels):
                parts = [np.bincount(label, w) for w in (None, squares, *x.T)]
                for c in np.flatnonzero(parts[0]):
                    found[k, c] = found.get((k, c), 0.0) + np.array([p[c] for p in parts], float)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int32()),
                                          pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["k", "c", "v"])

    added = [F.sum(F.get("v", i)).alias(f"v{i}") for i in range(width + 2)]
    stats = pd.DataFrame([tuple(r) for r in rows.mapInArrow(sums, "k int, c int, v array<double>").groupBy("k", "c").agg(*added).collect()])
    known = []
    for k in range(clusterings):
        of = stats[stats[0] == k].sort_values(1).to_numpy(float) if len(stats) else np.zeros((0, 4 + width))
        if len(of) < 2:
            raise ValueError("a silhouette needs two clusters at least")
        known.append((of[:, 1].astype(np.int64), of[:, 2], of[:, 3], of[:, 4:]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(clusterings), 0
        for batch in batches:
            x, squares, labels = split(batch)
            n += len(x)
            for k, (names, count, psi, y) in enumerate(known):
                own, at = np.searchsorted(names, labels[k]), np.arange(len(x))
                far = squares[:, None] + psi / count - 2.0 * (x @ y.T) / count
                size = count[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = far[at, own] * size / (size - 1.0)
                    far[at, own] = np.inf
                    b = far.min(axis=1)
                    s = np.where(a < b, 1.0 - a / b, np.where(a > b, b / a - 1.0, 0.0))
                total[k] += np.where(size == 1.0, 0.0, s).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(clusterings), pa.int32()), pa.array(total), pa.array([n] * clusterings, pa.int64())],
                                         names=["k", "s", "n"])

    scored = rows.mapInArrow(score, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    value = {r["k"]: float(r["s"]) for r in scored}
    return [value[k] for k in range(clusterings)]


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
