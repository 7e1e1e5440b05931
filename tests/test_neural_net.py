"""The ReLU net: gradients against finite differences, the same weights again, and what it learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.operators import neural_net as N


@pytest.mark.parametrize("hidden", [(100,), (120,), (200, 100, 50)])
def test_gradients_equal_finite_differences(hidden):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)), rng.integers(0, 2, 30).astype(float)
    sizes = [5, *hidden, 1]
    layers = N.start(sizes, 3)
    loss, gradients = N.loss_and_gradients(layers, x, y)
    values, g = N.flat(layers), N.flat(gradients)
    assert len(values) == len(g) and loss > 0
    for k in rng.choice(len(values), 40, replace=False):
        up, down = values.copy(), values.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (N.loss_and_gradients(N.shaped(up, sizes), x, y)[0] - N.loss_and_gradients(N.shaped(down, sizes), x, y)[0]) / 2e-6
        assert abs(slope - g[k]) < 1e-4


def rows(spark, n=240):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = (np.abs(x[:, 0]) + 0.3 * x[:, 1] > 0.8).astype(int)        # not linear
    return spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, label int").repartition(3)


def test_net_learns_and_repeats_itself(spark):
    df = rows(spark)
    net = N.fit_net(df, ["a", "b"], hidden=(30,), epochs=25, batch_rows=120, rate=0.02)
    assert net.losses[-1] < 0.6 * net.losses[0]
    out = net.transform(df).select("label", "prediction").toPandas()
    assert (out.label == out.prediction).mean() > 0.85
    again = N.fit_net(df.repartition(5), ["a", "b"], hidden=(30,), epochs=3, batch_rows=120, rate=0.02)
    first = N.fit_net(df, ["a", "b"], hidden=(30,), epochs=3, batch_rows=120, rate=0.02)
    assert (N.flat(again.layers) == N.flat(first.layers)).all() and net.losses[:3] == first.losses


def test_batch_gradient_is_the_sum_over_rows(spark):
    df = rows(spark, 60)
    layers = N.start([2, 8, 1], 1)
    pdf = df.toPandas()
    loss, g = N.loss_and_gradients(layers, pdf[["a", "b"]].to_numpy(), pdf.label.to_numpy(float))
    n, got, total = N.batch_gradient(df.select("label", "a", "b"), layers, 2)
    assert n == 60 and got == pytest.approx(loss) and np.allclose(total, N.flat(g))


def test_awkward_rows(spark):
    odd = spark.createDataFrame([(None, 1.0, 1), (2.0, 1.0, 0), (3.0, 1.0, None)], "a double, b double, label int")
    net = N.fit_net(odd, ["a", "b"], hidden=(4,), epochs=1)
    assert net.transform(odd).where(F.col("prediction").isNotNull()).count() == 3


def test_every_batch_is_in_partitions_of_its_own(spark):
    n, ways = 25_000, 2
    df = spark.range(n).select((F.col("id") % 3 % 2).cast("int").alias("b"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    blocks = N.packed(df.repartition(2, "b").sortWithinPartitions("b", "x"), 1, 2, ways)
    sizes = blocks.map(lambda r: r[0]).glom().collect()
    assert [sum(p) for p in sizes] == [10_000, 6_667, 8_333, 0] and max(max(p, default=0) for p in sizes) <= N.BLOCK
    layers = N.start([1, 4, 1], 1)
    for b in (0, 1):
        rows, loss, g = N.sum_of_gradients(blocks, range(b * ways, (b + 1) * ways), layers, 1)
        pdf = df.where(F.col("b") == b).toPandas()
        want, gradients = N.loss_and_gradients(layers, pdf[["x"]].to_numpy(), pdf.y.to_numpy(float))
        assert rows == len(pdf) and loss == pytest.approx(want) and np.allclose(g, N.flat(gradients))
