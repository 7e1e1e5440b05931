"""Extremely randomised trees, grown level by level on Spark.

Every tree sees all rows. At a node the features are put in an order drawn from a hash of (seed, tree, node,
feature); for the first ``max_features`` of them that vary within the node a cut is drawn uniformly
between the node's least and greatest value, and of these cuts the one with the least Gini impurity is
taken. Rows whose value is at most the cut go left.

One Spark job grows one level of all trees. Tasks route their rows through the trees grown so far and send,
per (tree, node, cut, side), the class counts and the least and greatest value of every feature; one
aggregate adds these up, picks each node's best cut and returns its two sides: the ranges
from which the next level draws. What a task or the driver holds grows with trees x nodes x cuts x features, not with rows.

Missing values: NULL and NaN go right and have no part in ranges. A tree of a node that can't be cut (pure,
under ``min_split`` rows, no feature varies, ``max_depth`` reached) ends there with its share of positives.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.session import keep_for_reuse


def draw(*key) -> float:
    """Uniform in [0, 1) from a hash of ``key``: the same in every run."""
    return int(hashlib.md5("#".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2.0**52


def cuts_of(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, float]]:
    """(feature, cut) candidates of a node named by its ``path`` (root 1, children 2p and 2p + 1)."""
    order = sorted(range(len(low)), key=lambda f: draw(seed, tree, path, f, "order"))
    out = []
    for f in [f for f in order if low[f] < high[f]][:most]:
        cut = low[f] + draw(seed, tree, path, f, "cut") * (high[f] - low[f])
        out.append((f, float(low[f] if cut >= high[f] else cut)))
    return out


class Tree:
    """Nodes as lists: feature (-1: a leaf), cut, left child (the right one follows it), share of positives."""

    def __init__(self):
        self.feature, self.cut, self.left, self.share = [-1], [0.0], [0], [0.0]

    def split(self, node: int, feature: int, cut: float) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for column, value in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.share, 0.0)):
            column.extend([value, value])
        return self.left[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.share)


def route(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, cut, left, _ = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = feature[at[rows]] >= 0
        rows = rows[inner]
        if not len(rows):
            return at
        node = at[rows]
        at[rows] = left[node] + ~(x[rows, feature[node]] <= cut[node])


def _level(data: DataFrame, width: int, trees: list[tuple[np.ndarray, ...]], live: list[tuple[int, int, list[tuple[int, float]]]], most: int) -> list:
    """Per live node (its number in ``live``) the two sides of its best cut: (number, cut, side, n, pos, low, high)."""
    number = [np.full(len(t[0]), -1) for t in trees]
    feature, cut = np.full((len(live), most), -1), np.zeros((len(live), most))
    for k, (tree, node, cuts) in enumerate(live):
        number[tree][node] = k
        for c, (f, v) in enumerate(cuts):
            feature[k, c], cut[k, c] = f, v
    growing = sorted({tree for tree, _, _ in live})
    schema = "g long, n long, pos long, low array<double>, high array<double>"

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = len(live) * most * 2
        n, pos = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
        low, high = np.full((groups, width), np.inf), np.full((groups, width), -np.inf)
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, width + 1)])
            y = batch.column(0).to_numpy(zero_copy_only=False) == 1
            for t in growing:
                k = number[t][route(trees[t], x)]
                rows = np.flatnonzero(k >= 0)
                for c in range(most):
                    f = feature[k[rows], c]
                    r = rows[f >= 0]
                    if not len(r):
                        continue
                    right = ~(x[r, f[f >= 0]] <= cut[k[r], c])
                    g = (k[r] * most + c) * 2 + right
                    order = np.argsort(g, kind="stable")
                    found, first = np.unique(g[order], return_index=True)
                    rows_in = r[order]
                    n[found] += np.diff(np.append(first, len(g)))
                    pos[found] += np.add.reduceat(y[rows_in].astype(np.int64), first)
                    low[found] = np.fmin(low[found], np.fmin.reduceat(x[rows_in], first, axis=0))
                    high[found] = np.fmax(high[found], np.fmax.reduceat(x[rows_in], first, axis=0))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(n[at]), pa.array(pos[at]), pa.array(list(low[at]), pa.list_(pa.float64())), pa.array(list(high[at]), pa.list_(pa.float64()))],
            names=["g", "n", "pos", "low", "high"])

    ends = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(width)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(width)]
    sides = data.mapInArrow(measure, schema).groupBy("g").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), *ends)
    sides = sides.withColumn("k", F.floor(F.col("g") / (2 * most))).withColumn("c", F.floor(F.col("g") / 2) % most)
    impurity = F.col("pos") * (F.col("n") - F.col("pos")) / F.col("n")
    per_cut = Window.partitionBy("k", "c")
    sides = sides.withColumn("score", F.round(F.sum(impurity).over(per_cut), 9)).withColumn("sides", F.count(F.lit(1)).over(per_cut))
    best = F.min(F.when(F.col("sides") == 2, F.struct("score", "c"))).over(Window.partitionBy("k"))
    rows = sides.withColumn("best", best).where(F.col("best.c") == F.col("c")).collect()
    return [(r["k"], r["c"], r["g"] % 2, r["n"], r["pos"], np.array([r[f"l{i}"] for i in range(width)]), np.array([r[f"h{i}"] for i in range(width)]))
            for r in rows]


class RandomizedTrees:
    """A fitted forest; ``transform`` adds ``probability`` and ``prediction`` as Spark ML models do."""

    def __init__(self, trees: list[Tree], features: Sequence[str], importances: np.ndarray):
        self.trees, self.features, self.importances = trees, list(features), importances

    @property
    def stages(self) -> list:
        return [self]

    @property
    def featureImportances(self) -> RandomizedTrees:  # noqa: N802 - the name Spark ML models use
        return self

    def toArray(self) -> np.ndarray:  # noqa: N802
        return self.importances

    def positive(self) -> Column:
        """Mean over the trees of the share of positives in a row's leaf."""
        trees = [t.arrays() for t in self.trees]

        @F.pandas_udf("double")
        def share(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            return pd.Series(sum(t[3][route(t, x)] for t in trees) / len(trees))

        return share(*[F.col(f).cast("double") for f in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__p", self.positive())
        df = df.withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p"))))
        return df.withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")


def grow(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 50, max_depth: int = 6,
         max_features: int | None = None, min_split: int = 2, seed: int = 42) -> RandomizedTrees:
    """Fit ``trees`` extremely randomised trees; one job for the ranges of the whole table, then one per level."""
    width = len(features)
    most = max_features or max(1, int(width**0.5))
    data = keep_for_reuse(train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("__y"), *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]))
    seen = [F.when(~F.isnan(f"__x{i}"), F.col(f"__x{i}")) for i in range(width)]
    root = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("__y")), F.lit(0)).alias("pos"),
                    *[F.min(c).alias(f"l{i}") for i, c in enumerate(seen)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(seen)]).first()
    low, high = (np.array([np.nan if root[f"{s}{i}"] is None else root[f"{s}{i}"] for i in range(width)]) for s in "lh")
    total, gain = root["n"], np.zeros(width)
    forest = [Tree() for _ in range(trees)]
    for t in forest:
        t.share[0] = root["pos"] / total if total else 0.0
    # live: (tree, node, path, n, positives, least and greatest value of each feature)
    live = [(t, 0, 1, total, root["pos"], low, high) for t in range(trees)]
    for _ in range(max_depth):
        asked = []
        for node in live:
            tree, at, path, n, pos, lo, hi = node
            cuts = cuts_of(seed, tree, path, lo, hi, most) if n >= min_split and 0 < pos < n else []
            if cuts:
                asked.append((node, cuts))
        if not asked:
            break
        sides = _level(data, width, [t.arrays() for t in forest], [(node[0], node[1], cuts) for node, cuts in asked], most)
        by_node: dict[int, dict[int, tuple]] = {}
        for k, c, side, n, pos, lo, hi in sides:
            by_node.setdefault(k, {})[side] = (c, n, pos, lo, hi)
        live = []
        for k in sorted(by_node):
            (tree, at, path, n, pos, *_), cuts = asked[k]
            f, cut = cuts[by_node[k][0][0]]
            left = forest[tree].split(at, f, cut)
            gain[f] += pos * (n - pos) / n - sum(p * (m - p) / m for _, m, p, *_ in by_node[k].values())
            for side, (_, m, p, lo, hi) in sorted(by_node[k].items()):
                forest[tree].share[left + side] = p / m
                live.append((tree, left + side, 2 * path + side, m, p, lo, hi))
    return RandomizedTrees(forest, features, gain / gain.sum() if gain.sum() > 0 else gain)


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
