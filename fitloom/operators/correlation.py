"""Correlation of many columns from blocked cross products (F8, M2).

With X the shifted values (NULL and NaN as 0) and M the 0/1 matrix of present ones, X'X, X'M, (X*X)'M and M'M hold
all sums that the correlation of every pair over its common rows needs. A task adds up these matrices over its
Arrow batches and sends them in blocks of ``block`` columns; blocks are summed as they stream in, first
in ``WAYS`` parts, then together. Work is one matrix product per batch, and the plan has the same size for
five columns as for thousands.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 16
PARTS = 6   # n, x, y, xx, yy, xy of a block pair
BLOCK_SCHEMA = "bi int, bj int, way int, sums binary"


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Sums of equal (bi, bj, way), which follow each other."""
    now, total = None, None
    for batch in batches:
        for bi, bj, way, raw in zip(*[batch.column(k) for k in range(4)], strict=True):
            key, values = (bi.as_py(), bj.as_py(), way.as_py()), np.frombuffer(raw.as_buffer(), np.float64)
            if key == now:
                total = total + values
            else:
                if now is not None:
                    yield (*now, total)
                now, total = key, values
    if now is not None:
        yield (*now, total)


def blocked_correlation(df: DataFrame, cols: Sequence[str], block: int = 256) -> DataFrame:
    """(feature_a, feature_b, abs_corr) of every pair a before b, over the rows where both are present; NULL where one does not vary."""
    names, width = list(cols), len(cols)
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"__x{i}") for i, c in enumerate(names)]
    data = df.select(*values)
    means = data.agg(*[F.avg(f"__x{i}").alias(f"m{i}") for i in range(width)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    starts = list(range(0, width, block))

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, s, q, p = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]) - shift
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            p += x.T @ x
        way = TaskContext.get().partitionId() % WAYS
        for a, i in enumerate(starts):
            for b, j in enumerate(starts[a:], a):
                r, c = slice(i, i + block), slice(j, j + block)
                sums = np.stack([n[r, c], s[r, c], s[c, r].T, q[r, c], q[c, r].T, p[r, c]])
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([way], pa.int32()),
                                                  pa.array([sums.tobytes()])], names=["bi", "bj", "way", "sums"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, _, total in _summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([total.tobytes()])], names=["bi", "bj", "way", "sums"])

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, _, total in _summed(batches):
            rows, columns = min(block, width - starts[bi]), min(block, width - starts[bj])
            n, x, y, xx, yy, xy = total.reshape(PARTS, rows, columns)
            with np.errstate(divide="ignore", invalid="ignore"):
                vx, vy = xx - x * x / n, yy - y * y / n
                flat = (vx <= 1e-12 * np.maximum(xx, 1e-300)) | (vy <= 1e-12 * np.maximum(yy, 1e-300))
                corr = np.abs(xy - x * y / n) / np.sqrt(vx * vy)
            i, j = np.meshgrid(np.arange(rows) + starts[bi], np.arange(columns) + starts[bj], indexing="ij")
            keep = i < j
            corr = np.where(flat | (n < 2), np.nan, np.minimum(corr, 1.0))[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in i[keep]], pa.string()), pa.array([names[k] for k in j[keep]], pa.string()),
                 pa.array(corr, mask=np.isnan(corr))], names=["feature_a", "feature_b", "abs_corr"])

    blocks = data.mapInArrow(cross, BLOCK_SCHEMA).repartition("bi", "bj", "way").sortWithinPartitions("bi", "bj", "way")
    blocks = blocks.mapInArrow(added, BLOCK_SCHEMA).repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return blocks.mapInArrow(pairs, "feature_a string, feature_b string, abs_corr double")


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
