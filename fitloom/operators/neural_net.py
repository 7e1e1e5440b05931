"""Neural net with ReLU layers, trained by mini-batch Adam on Spark.

Rows are standardised, dealt to mini-batches by a hash and written once as blocks of numbers, every batch in partitions
of its own. A step is one job over the partitions of its batch and nothing else: no query is planned for it, no file
listed. Tasks run the net forward and back over their blocks and send one sum of gradients each (at most ``WAYS`` of
them); the driver adds them up in the order of the partitions and makes the Adam step. What travels per step is as
large as the weights, whatever the number of rows.

The loss is the log loss plus ``alpha`` / 2 times the squared weights per batch row, weights start as Glorot
uniform draws, and training ends after ``epochs`` or when ``patience`` epochs bring no gain of ``tolerance``.
The same rows give the same weights; equal rows share a batch. NULL features count as the mean.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.operators.encode import fit_standard
from fitloom.session import checkpoint_dir

WAYS = 64           # most tasks of a step
TASK_ROWS = 100_000     # rows of a batch in one task, until there are WAYS of them
BLOCK = 10_000      # rows of a block
BATCHES = 200       # most mini-batches of an epoch; larger tables have larger batches
Layers = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: Sequence[int], seed: int) -> Layers:
    """Glorot uniform weights and offsets of every layer."""
    rng = np.random.default_rng(seed)
    bounds = [np.sqrt((6.0 if k < len(sizes) - 2 else 2.0) / (a + b)) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]
    return [(rng.uniform(-b, b, (n, m)), rng.uniform(-b, b, m)) for b, n, m in zip(bounds, sizes, sizes[1:], strict=False)]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """Values of every layer; the last is the margin."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0.0) if k < len(layers) - 1 else z)
    return out


def loss_and_gradients(layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[float, Layers]:
    """Sum of the log losses of the rows, and its gradients."""
    values = forward(layers, x)
    margin = values[-1][:, 0]
    loss = float((np.logaddexp(0.0, margin) - y * margin).sum())
    delta = (1.0 / (1.0 + np.exp(-margin)) - y)[:, None]
    out: Layers = []
    for k in range(len(layers) - 1, -1, -1):
        out.append((values[k].T @ delta, delta.sum(axis=0)))
        if k:
            delta = (delta @ layers[k][0].T) * (values[k] > 0)
    return loss, out[::-1]


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def shaped(values: np.ndarray, sizes: Sequence[int]) -> Layers:
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:], strict=False):
        out.append((values[at:at + n * m].reshape(n, m), values[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def packed(rows: DataFrame, width: int, batches: int, ways: int) -> RDD:
    """Blocks (rows, labels, features) of the mini-batches: batch b is in the partitions b * ways to b * ways + ways - 1.

    ``rows`` has the batch, the label and ``width`` features, its partitions whole batches one after the other.
    """

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "n", "y", "x"]

        def block(b: int, k: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            y, x = (np.concatenate(v) for v in zip(*held, strict=True))
            arrays = [pa.array([b * ways + k % ways], pa.int32()), pa.array([len(y)], pa.int32()), pa.array([y.tobytes()]), pa.array([x.tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        now, k, held, size = -1, 0, [], 0
        for batch in found:
            of, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x, y, at = np.column_stack(x).astype(float), y.astype(float), 0
            while at < len(y):
                if of[at] != now or size == BLOCK:                  # blocks are counted from their batch's first row
                    if size:
                        yield block(now, k, held)
                    k = k + 1 if of[at] == now else 0
                    now, held, size = of[at], [], 0
                end = min(int(np.searchsorted(of, now, "right")), at + BLOCK - size)
                held.append((y[at:end], x[at:end]))
                size, at = size + end - at, end
        if size:
            yield block(now, k, held)

    blocks = rows.mapInArrow(run, "part int, n int, y binary, x binary").rdd
    return blocks.map(lambda r: (r[0], (r[1], bytes(r[2]), bytes(r[3])))).partitionBy(batches * ways, int).values()


def sum_of_gradients(blocks: RDD, parts: Sequence[int], layers: Layers, width: int) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient over the partitions ``parts``: a sum per task, added up in the order of the partitions."""

    def run(found: Iterable[tuple[int, bytes, bytes]]) -> list[tuple[int, float, bytes]]:
        n, loss, total = 0, 0.0, 0.0
        for rows, y, x in found:
            one, gradients = loss_and_gradients(layers, np.frombuffer(x).reshape(rows, width), np.frombuffer(y))
            n, loss, total = n + rows, loss + one, total + flat(gradients)
        return [(n, loss, total.tobytes())] if n else []

    sums = blocks.context.runJob(blocks, run, list(parts))
    total = sum((np.frombuffer(g) for _, _, g in sums), np.zeros(len(flat(layers))))
    return sum(n for n, _, _ in sums), sum(loss for _, loss, _ in sums), total


def batch_gradient(rows: DataFrame, layers: Layers, width: int) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient of one mini-batch: the label and ``width`` features."""
    one = packed(rows.select(F.lit(0).alias("__b"), *rows.columns).coalesce(WAYS), width, 1, 1)
    return sum_of_gradients(one, [0], layers, width)


class ReluNet:
    """A fitted net; ``transform`` adds ``probability`` and ``prediction`` as Spark ML models do."""

    def __init__(self, layers: Layers, features: Sequence[str], scale: dict[str, tuple[float, float]], losses: list[float]):
        self.layers, self.features, self.scale, self.losses = layers, list(features), scale, losses

    def positive(self) -> Column:
        layers = self.layers

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            margin = forward(layers, np.column_stack([c.to_numpy(float) for c in columns]))[-1][:, 0]
            return pd.Series(1.0 / (1.0 + np.exp(-margin)))

        return probability(*scaled(self.features, self.scale))

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("__p", self.positive())
        df = df.withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p"))))
        return df.withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")


def scaled(features: Sequence[str], scale: dict[str, tuple[float, float]]) -> list[Column]:
    out = []
    for f in features:
        mean, std = scale[f]
        out.append(F.coalesce((F.col(f).cast("double") - F.lit(float(mean or 0.0))) / F.lit(float(std)), F.lit(0.0)))
    return out


def fit_net(train: DataFrame, features: Sequence[str], label: str = "label", hidden: Sequence[int] = (100,), epochs: int = 200,
            batch_rows: int = 200, rate: float = 1e-3, alpha: float = 1e-4, tolerance: float = 1e-4, patience: int = 10, seed: int = 42) -> ReluNet:
    """Fit a net with ``hidden`` ReLU layers on rows with a label."""
    spark, width = train.sparkSession, len(features)
    train = train.where(F.col(label).isNotNull())
    # rounded, since sums of doubles depend on the partitions
    scale = {f: (round(m or 0.0, 9), round(d, 9) or 1.0) for f, (m, d) in fit_standard(train, features).items()}
    rows = train.select(F.col(label).cast("int").alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(scaled(features, scale))])
    n = rows.count()
    batches = min(BATCHES, max(1, -(-n // batch_rows)))
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(batches)).cast("int"))
    # the order within a batch is fixed by the values, so that sums are the same in every run
    dealt = dealt.repartition(batches, "__b").sortWithinPartitions("__b", *rows.columns).select("__b", *rows.columns)
    ways = min(WAYS, max(1, -(-n // (batches * TASK_ROWS))))
    checkpoint_dir(spark)
    blocks = packed(dealt, width, batches, ways)
    blocks.checkpoint()
    blocks.count()
    sizes = [width, *hidden, 1]
    layers = start(sizes, seed)
    first, second, steps, losses, best, idle = 0.0, 0.0, 0, [], np.inf, 0
    order = np.random.default_rng(seed)
    for _ in range(epochs if n else 0):
        loss = 0.0
        for b in order.permutation(batches):
            m, one, g = sum_of_gradients(blocks, range(int(b) * ways, (int(b) + 1) * ways), layers, width)
            if not m:
                continue
            weights = [(alpha * w, np.zeros_like(o)) for w, o in layers]
            g = (g + flat(weights)) / m
            loss += one + alpha / 2 * sum(float((w * w).sum()) for w, _ in layers)
            steps += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            step = rate * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            layers = shaped(flat(layers) - step * first / (np.sqrt(second) + 1e-8), sizes)
        losses.append(loss / n)
        idle = 0 if losses[-1] < best - tolerance else idle + 1
        best = min(best, losses[-1])
        if idle >= patience:
            break
    return ReluNet(layers, features, scale, losses)


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
