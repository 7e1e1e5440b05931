"""k-means with restarts: all restarts of all numbers of clusters (and all views) advance together (L1, L3, L4).

A pass over the rows assigns each one to its centre in every run at once (one matrix product per Arrow batch) and
sums per (run, centre); one aggregate adds these up. So the number of passes is that of the slowest run,
whatever the number of runs. Of the restarts of one (view, k) the one of least cost is kept (ties: the first).

First centres are drawn by k-means++ from a bounded sample: the ``SAMPLE`` training rows that come first in md5 order
of their values. Only the drawing uses it; every pass covers all rows. NULL features count as 0 after scaling.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.operators.cluster import nearest_centroid
from fitloom.operators.encode import fit_robust, fit_standard
from fitloom.session import keep_for_reuse

SAMPLE = 5000


def plus_plus(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre drawn with the squared distance to the nearest one so far as weight."""
    centres = [rows[rng.integers(len(rows))]]
    for _ in range(k - 1):
        d = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[rng.choice(len(rows), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(rows))])
    return np.array(centres)


def _pass(data: DataFrame, runs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass for all runs (columns, centres): sums and counts per centre, and the cost, of every run."""
    width = max(len(c) for c, _ in runs)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), len(cols))) for cols, c in runs]
        counts, costs = [np.zeros(len(c), np.int64) for _, c in runs], [np.zeros(len(c)) for _, c in runs]
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            for r, (cols, c) in enumerate(runs):
                v = x[:, cols]
                d = (c * c).sum(axis=1) - 2.0 * (v @ c.T)
                near = d.argmin(axis=1)
                counts[r] += np.bincount(near, minlength=len(c))
                for k in range(len(cols)):
                    sums[r][:, k] += np.bincount(near, weights=v[:, k], minlength=len(c))
                costs[r] += np.bincount(near, weights=((v - c[near]) ** 2).sum(axis=1), minlength=len(c))
        rows = [(r, k, int(counts[r][k]), float(costs[r][k]), list(sums[r][k]) + [0.0] * (width - len(cols)))
                for r, (cols, c) in enumerate(runs) for k in range(len(c)) if counts[r][k]]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["run", "centre", "n", "cost", "sums"])

    made = data.mapInArrow(assign, "run int, centre int, n long, cost double, sums array<double>")
    added = made.groupBy("run", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                              *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
    out = [(np.zeros((len(c), len(cols))), np.zeros(len(c)), 0.0) for cols, c in runs]
    for row in sorted(added, key=lambda x: (x["run"], x["centre"])):
        sums, counts, cost = out[row["run"]]
        sums[row["centre"]] = [row[f"s{i}"] for i in range(sums.shape[1])]
        counts[row["centre"]] = row["n"]
        out[row["run"]] = (sums, counts, cost + row["cost"])
    return out


class KMeansRuns:
    """The kept run of every (view, k): centres in scaled units, cost and the passes that were made."""

    def __init__(self, scaled: dict, kept: dict, costs: dict, passes: int):
        self.scaled, self.kept, self.costs, self.passes = scaled, kept, costs, passes

    def label(self, df: DataFrame) -> DataFrame:
        """``df`` with one cluster column per (view, k), named by its key."""
        rows = df.withColumns(self.scaled)
        labels = {name: nearest_centroid(cols, centres.tolist()) for name, (cols, centres) in self.kept.items()}
        return rows.withColumns(labels).drop(*self.scaled)


def fit_runs(train: DataFrame, views: dict[str, tuple[Sequence[str], int]], restarts: int = 10, seed: int = 42, max_iter: int = 20,
             scaling: str = "standard", tolerance: float = 1e-4) -> KMeansRuns:
    """Fit ``{name: (features, k)}``, each from ``restarts`` starts, all in the same passes."""
    features = list(dict.fromkeys(f for cols, _ in views.values() for f in cols))
    params = fit_standard(train, features) if scaling == "standard" else fit_robust(train, features)
    scaled = {f"__k{i}": F.coalesce((F.col(f) - F.lit(params[f][0])) / F.lit(params[f][1]), F.lit(0.0)) for i, f in enumerate(features)}
    data = keep_for_reuse(train.select(*[c.alias(n) for n, c in scaled.items()]))
    by_hash = F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(n).cast("string") for n in scaled]))
    sample = np.array(data.orderBy(by_hash).limit(SAMPLE).collect(), float).reshape(-1, len(features))
    if not len(sample):
        raise ValueError("no rows to fit on")
    runs, owner = [], []
    for v, (name, (cols, k)) in enumerate(views.items()):
        at = np.array([features.index(c) for c in cols])
        for r in range(restarts):
            runs.append((at, plus_plus(sample[:, at], k, np.random.default_rng([seed, v, r]))))
            owner.append(name)
    passes = 0
    for passes in range(1, max_iter + 2):   # the last pass measures the cost of the last centres
        measured = _pass(data, runs)
        moved, new = 0.0, []
        for (cols, centres), (sums, counts, _) in zip(runs, measured, strict=True):
            mean = np.where(counts[:, None] > 0, np.round(sums / np.maximum(counts, 1)[:, None], 9), centres)
            moved = max(moved, float(((mean - centres) ** 2).sum(axis=1).max()))
            new.append((cols, mean))
        if moved <= tolerance**2 or passes > max_iter:
            break
        runs = new
    kept, costs = {}, {}
    for (cols, centres), (_, _, cost), name in zip(runs, measured, owner, strict=True):
        costs.setdefault(name, []).append(cost)
        if cost <= min(costs[name]) and (name not in kept or cost < min(costs[name][:-1])):
            kept[name] = ([f"__k{i}" for i in cols], centres)
    return KMeansRuns(scaled, kept, costs, passes)


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
