"""Logistic regression over sparse one-hot features whose width no process holds.

The widest category column has its coefficients where its rows are: the training rows are packed once into blocks of whole
places (a place is a category's position in the vector), about ``BLOCK_ROWS`` rows each, and a block's coefficients, and all
other vectors of the fit on its places, stay in it. The driver holds the others only: numeric features, the narrower
category columns, and places with more than ``BLOCK_ROWS`` rows (so a hot category is spread over many blocks).

L-BFGS starts at zero, so its points and directions are sums of the gradients so far (and of the means, by which features are
centred). A block keeps these as its basis; the driver keeps the factors and the basis' dot products and does the
same steps (history of 10, strong Wolfe line search, stopping rules, standardised features, mean loss) as
``pyspark.ml.classification.LogisticRegression``. An evaluation is one pass over the blocks, which writes them with one more
basis vector; the former table is deleted.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join
from fitloom.operators.sparse_onehot import SparseOneHot
from fitloom.session import checkpoint_dir, cut_lineage, shuffles_freed

# Rows of a block of whole places, and places that one block may have.
BLOCK_ROWS = 50_000
BLOCK_PLACES = 65_536
HISTORY = 10
VALUES_KEPT = 20

_BLOCK = "c int, s long, places binary, counts binary, label binary, num binary, head binary, istd binary, basis binary, sums array<double>"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _blocks_one_by_one(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


class _Tables:
    """Tables under the shared checkpoint folder that are deleted by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        # a row is a block of some MB: few to a row group, which readers load whole
        df.write.option("parquet.block.row.count.limit", "4").option("parquet.enable.dictionary", "false").parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        found = sc._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(sc._jsc.hadoopConfiguration()).delete(found, True)


def _record_batch(rows):
    import pyarrow as pa

    types = [pa.int32(), pa.int64(), *[pa.binary()] * 7, pa.list_(pa.float64())]
    names = ["c", "s", "places", "counts", "label", "num", "head", "istd", "basis", "sums"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _inverse_std(count, n):
    """1 / sample deviation of a 0/1 feature that is 1 in ``count`` of ``n`` rows; 0 where it is constant."""
    count = np.asarray(count, float)
    var = np.maximum(count - count * count / n, 0.0) / max(n - 1, 1)
    return np.where(var > 0, 1.0 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)


def _pack(n: int, n_num: int, n_head: int) -> Callable:
    """mapInArrow body: rows ordered by (c, s, place) to one row per block."""
    def column(batch, name, width):
        flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(batch.num_rows, width)

    def packed(key, parts):
        place, label, num, head = (np.concatenate(p) for p in zip(*parts, strict=True))
        places, counts = (np.unique(place, return_counts=True) if key[0] >= 0 else (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        istd = _inverse_std(counts, n)
        means = istd * counts / n
        return _record_batch([(*key, places.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), label.astype(np.int8).tobytes(),
                               np.ascontiguousarray(num, float).tobytes(), np.ascontiguousarray(head, np.int32).tobytes(), istd.tobytes(), means.tobytes(),
                               [float(means @ means)])])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            c, s = batch.column("c").to_numpy(), batch.column("s").to_numpy()
            place, label = batch.column("place").to_numpy(), batch.column("label").to_numpy()
            num, head = column(batch, "num", n_num), column(batch, "head", n_head)
            starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])]))
            for lo, hi in zip(starts, [*starts[1:], len(c)], strict=True):
                if key != (int(c[lo]), int(s[lo])):
                    if parts:
                        yield packed(key, parts)
                    key, parts = (int(c[lo]), int(s[lo])), []
                parts.append((place[lo:hi].copy(), label[lo:hi].copy(), num[lo:hi].copy(), head[lo:hi].copy()))
        if parts:
            yield packed(key, parts)
    return run


def _evaluate(factors, n_num: int, num_w, head_w, offset: float) -> Callable:
    """mapInArrow body: every block with the raw gradient of its places added to its basis, and its share of the sums:
    loss, multipliers, gradients of the numeric and of the other head features, dot products with the basis, with itself."""
    k, n_other = len(factors), len(head_w)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts, label = np.frombuffer(r["counts"], np.int32), np.frombuffer(r["label"], np.int8)
                istd = np.frombuffer(r["istd"])
                basis = np.frombuffer(r["basis"]).reshape(k, len(istd))
                num, head = np.frombuffer(r["num"]).reshape(len(label), n_num), np.frombuffer(r["head"], np.int32).reshape(len(label), -1)
                margin = offset + (num @ num_w if n_num else 0.0) + np.append(head_w, 0.0)[head].sum(axis=1)     # -1: no place
                if len(counts):
                    margin = margin + np.repeat((factors @ basis) * istd, counts)
                mult = 1.0 / (1.0 + np.exp(np.minimum(-margin, 700.0))) - label
                loss = np.logaddexp(0.0, -margin).sum() + margin[label == 0].sum()
                new = istd * np.add.reduceat(mult, np.concatenate([[0], np.cumsum(counts)[:-1]])) if len(counts) else np.zeros(0)
                by_head = np.zeros(n_other + 1)
                for j in range(head.shape[1]):
                    by_head += np.bincount(np.where(head[:, j] < 0, n_other, head[:, j]), mult, n_other + 1)
                sums = [loss, mult.sum(), *(mult @ num if n_num else ()), *by_head[:n_other], *(basis @ new), new @ new]
                yield _record_batch([(r["c"], r["s"], r["places"], r["counts"], r["label"], r["num"], r["head"], r["istd"], r["basis"] + new.tobytes(),
                                      [float(x) for x in sums])])
    return run


def _coefficients(factors) -> Callable:
    """mapInArrow body: place and coefficient (of the feature as it is) of every block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                istd = np.frombuffer(r["istd"])
                w = (factors @ np.frombuffer(r["basis"]).reshape(len(factors), len(istd))) * istd
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["places"], np.int32)), pa.array(w)], ["place", "coef"])
    return run


class _Failed(Exception):
    """The line search found no point, or the history is no use."""


class _Vectors:
    """Vectors as the driver knows them: ``head`` numbers, then factors of the basis that the blocks hold."""

    def __init__(self, n_head: int, mean_square: float):
        self.n, self.gram = n_head, np.array([[mean_square]])

    def pad(self, v):
        return np.concatenate([v, np.zeros(self.n + len(self.gram) - len(v))])

    def dot(self, u, v) -> float:
        u, v = self.pad(u), self.pad(v)
        return float(u[:self.n] @ v[:self.n] + u[self.n:] @ self.gram @ v[self.n:])

    def norm(self, v) -> float:
        return math.sqrt(max(self.dot(v, v), 0.0))

    def add(self, u, factor: float, v):
        return self.pad(u) + factor * self.pad(v)

    def grow(self, products, square: float) -> None:
        products = np.asarray(products, float)
        self.gram = np.block([[self.gram, products[:, None]], [products[None, :], np.array([[square]])]])


def _cubic(left, right) -> float:
    (lt, lv, ld), (rt, rv, rd) = left[:3], right[:3]
    d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
    root = d1 * d1 - ld * rd
    d2 = math.sqrt(root) if root >= 0 else math.nan
    bottom = rd - ld + 2 * d2
    t = rt - (rt - lt) * (rd + d2 - d1) / bottom if bottom != 0 else math.nan
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _line_search(phi: Callable, start, init: float, rounds: int = 10):
    """A point (step, value, slope, state) with the strong Wolfe conditions."""
    _, value, slope = start[:3]
    if slope > 0:
        raise _Failed("not a descent direction")

    def zoom(low, high):
        for _ in range(rounds):
            c = phi(_cubic(high, low) if low[0] > high[0] else _cubic(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed("zoom failed")

    t, low = init, start
    for i in range(rounds):
        c = phi(t)
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed("line search failed")


def _direction(v: _Vectors, steps, deltas, grad):
    scale = 1.0
    if steps:
        sy = v.dot(steps[0], deltas[0])
        if sy < 0 or math.isnan(sy):
            raise _Failed("no curvature")
        scale = sy / v.dot(deltas[0], deltas[0])
    out, kept = v.pad(grad), []
    for s, y in zip(steps, deltas, strict=True):
        rho = v.dot(s, y)
        a = v.dot(s, out) / rho
        kept.append((a, rho))
        out = v.add(out, -a, y)
    out = out * scale
    for s, y, (a, rho) in reversed([*zip(steps, deltas, kept, strict=True)]):
        out = v.add(out, a - v.dot(y, out) / rho, s)
    return -out


def _minimise(v: _Vectors, objective: Callable, x, max_iter: int, tol: float):
    """The last point of L-BFGS on ``objective(x) -> (value, gradient)``."""
    value, grad = objective(x)
    first, values, steps, deltas, failed, done = value, [math.inf], [], [], False, 0
    while done < max_iter:
        if len(values) >= 2 and abs(value - max(values)) <= tol * abs(first):
            break
        if v.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        try:
            d = _direction(v, steps, deltas, grad)

            def phi(t, x=x, d=d):
                at = v.add(x, t, d)
                found, g = objective(at)
                return t, found, v.dot(g, d), (at, g)

            step, new_value, _, (new_x, new_grad) = _line_search(phi, (0.0, value, v.dot(grad, d), None), 1.0 / v.norm(d) if done == 0 else 1.0)
            if step * v.norm(grad) < 1e-10:
                raise _Failed("step too small")
        except _Failed:
            if failed:
                break
            failed, steps, deltas = True, [], []
            continue
        steps, deltas = [v.add(new_x, -1.0, x), *steps][:HISTORY], [v.add(new_grad, -1.0, grad), *deltas][:HISTORY]
        x, value, grad, failed, done = new_x, new_value, new_grad, False, done + 1
        values = [*values, value][-VALUES_KEPT:]
    return x


def logistic_scores(fitted: SparseOneHot, train: DataFrame, score: DataFrame, keep: list[str], label: str = "label", max_iter: int = 20,
                    reg: float = 0.01, tol: float = 1e-6, block_rows: int | None = None) -> DataFrame:
    """``keep`` and the probability ``prob`` of class 1 of every row of ``score``, by a fit on ``train``.

    Labels are 0 and 1 (others and NULL raise). If all are equal, so are the probabilities. NULL numbers count as 0.
    """
    with shuffles_freed(train.sparkSession):
        return _logistic_scores(fitted, train, score, keep, label, max_iter, reg, tol, block_rows or BLOCK_ROWS)


def _logistic_scores(fitted, train, score, keep, label, max_iter, reg, tol, block_rows):
    spark, tables = train.sparkSession, _Tables(train.sparkSession)
    columns = list(fitted.tables)
    wide = max(range(len(columns)), key=lambda i: fitted.tables[columns[i]][2])
    others = [i for i in range(len(columns)) if i != wide]
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in fitted.numeric]).cast("array<double>")
    n_num = len(fitted.numeric)

    rows = fitted.placed(train).select(F.col(label).cast("double").alias("label"), numbers.alias("num"),
                                       *[F.col(f"__place{i}") for i in range(len(columns))])
    rows = cut_lineage(rows).withColumn("__at", F.monotonically_increasing_id())       # the same numbers in every reading
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"),
                     *[F.avg(F.get("num", j)).alias(f"m{j}") for j in range(n_num)],
                     *[F.var_samp(F.get("num", j)).alias(f"v{j}") for j in range(n_num)]).first()
    n, ones = stats["n"], stats["ones"]
    if not n or ones + stats["zeros"] != n:
        raise ValueError("labels must be 0 or 1, of at least one row")
    if ones in (0, n):
        return score.select(*keep, F.lit(float(ones == n)).alias("prob"))

    counts = rows.where(F.col(f"__place{wide}").isNotNull()).groupBy(F.col(f"__place{wide}").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    hot = sorted((r["place"], r["n"]) for r in counts.where(F.col("n") > block_rows).collect())
    # the places that the driver holds: those of the narrower columns, then the hot ones
    held = [(r["p"], r["n"]) for i in others for r in
            rows.where(F.col(f"__place{i}").isNotNull()).groupBy(F.col(f"__place{i}").alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    held += hot
    slot = spark.createDataFrame([(p, j) for j, (p, _) in enumerate(held)], "place int, slot int")

    before = Window.partitionBy("c").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (counts.where(F.col("n") <= block_rows).withColumn("c", F.floor(F.col("place") / BLOCK_PLACES).cast("int"))
              .select("place", "c", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows).cast("long").alias("s")))
    for i in [*others, wide]:
        rows = lookup_join(rows, slot.select(F.col("place").alias(f"__place{i}"), F.col("slot").alias(f"__slot{i}")), f"__place{i}", "left")
    rows = lookup_join(rows, blocks.select(F.col("place").alias(f"__place{wide}"), "c", "s"), f"__place{wide}", "left")
    # rows of no block of places: as they come
    free = F.shiftright("__at", 33) * 1_000_000 + F.floor(F.col("__at").bitwiseAND(F.lit(2**33 - 1)) / block_rows)
    rows = rows.select(F.coalesce("c", F.lit(-1)).alias("c"), F.coalesce("s", free.cast("long")).alias("s"), F.col(f"__place{wide}").alias("place"),
                       F.col("label").cast("tinyint").alias("label"), "num",
                       F.array(*[F.coalesce(F.col(f"__slot{i}"), F.lit(-1)) for i in [*others, wide]]).alias("head"))
    rows = rows.fillna(-1, ["place"]).repartition("c", "s").sortWithinPartitions("c", "s", "place")
    path, table = tables.write(rows.mapInArrow(_pack(n, n_num, len(columns)), _BLOCK))

    var = np.array([stats[f"v{j}"] or 0.0 for j in range(n_num)])
    istd = np.concatenate([np.where(var > 0, 1.0 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0), _inverse_std([m for _, m in held], n)])
    means = istd * np.concatenate([[stats[f"m{j}"] for j in range(n_num)], np.array([m for _, m in held], float) / n])
    width = len(istd)                                    # of the head without the intercept, its last number

    def summed(frame):
        found = frame.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found)])

    vectors = _Vectors(width + 1, float(summed(table)[0]))

    def objective(x):
        nonlocal path, table
        x = vectors.pad(x)
        head, intercept, factors = x[:width], x[width], x[width + 1:]
        offset = intercept - head @ means - float(vectors.gram[0] @ factors)
        weights = head * istd
        with _blocks_one_by_one(spark):
            body = _evaluate(factors, n_num, weights[:n_num], weights[n_num:], float(offset))
            new_path, new = tables.write(table.mapInArrow(body, _BLOCK))
        tables.delete(path)
        path, table = new_path, new
        sums = summed(table)
        loss, mult, by_head, products = sums[0], sums[1], sums[2:2 + width] * istd, sums[2 + width:]
        square = vectors.dot(np.concatenate([head, [0.0], factors]), np.concatenate([head, [0.0], factors]))
        vectors.grow(products[:-1], products[-1])
        grad = np.concatenate([(by_head - mult * means) / n + reg * head, [mult / n], reg * factors, [1.0 / n]])
        grad[width + 1] -= mult / n                      # the means are the first of the basis
        return loss / n + 0.5 * reg * square, grad

    start = np.zeros(width + 2)
    start[width] = math.log(ones / (n - ones))
    x = vectors.pad(_minimise(vectors, objective, start, max_iter, tol))
    head, factors = x[:width], x[width + 1:]
    intercept = float(x[width] - head @ means - vectors.gram[0] @ factors)
    head = head * istd

    with _blocks_one_by_one(spark):
        coefs = cut_lineage(table.mapInArrow(_coefficients(factors), "place int, coef double"))
    tables.delete(path)
    coefs = coefs.unionByName(spark.createDataFrame([(p, float(w)) for (p, _), w in zip(held, head[n_num:], strict=True)], "place int, coef double"))
    out = fitted.placed(score)
    margin = F.lit(intercept)
    for j, c in enumerate(fitted.numeric):
        margin = margin + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(head[j]))
    for i in range(len(columns)):
        _, lo, size = fitted.tables[columns[i]]
        own = coefs.where((F.col("place") >= lo) & (F.col("place") < lo + size))
        out = lookup_join(out, own.select(F.col("place").alias(f"__place{i}"), F.col("coef").alias(f"__coef{i}")), f"__place{i}", "left")
        margin = margin + F.coalesce(F.col(f"__coef{i}"), F.lit(0.0))
    return out.select(*keep, (1.0 / (1.0 + F.exp(-margin))).alias("prob"))


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
