"""Logistic regression with the coefficients in the tasks, against Spark's own on whole vectors."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fitloom.operators import sparse_logistic as SL
from fitloom.operators.sparse_onehot import fit_sparse_one_hot


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, who long, v double, label int")


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        who = 7 if i % 3 == 0 else int(rng.integers(0, 250))             # one with a third of all rows
        v = float(rng.normal(100.0, 30.0))
        p = 1 / (1 + np.exp(-(v - 100) / 20 - (who % 5 - 2)))
        rows.append((i, None if i % 13 == 0 else "abcd"[i % 4], None if i % 17 == 0 else who, None if i % 19 == 0 else v, int(rng.random() < p)))
    return _table(spark, [*rows, *rows[:50]])                            # rows that come twice


def _by_spark(fitted, train, score):
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=6, regParam=0.01, standardization=True).fit(fitted.vectors(train, ["id", "label"]))
    out = model.transform(fitted.vectors(score, ["id"])).select("id", vector_to_array("probability")[1].alias("prob"))
    return sorted((r["id"], r["prob"]) for r in out.collect())


def test_scores_are_those_of_the_fit_on_whole_vectors(people):
    train, score = people.where("id % 4 > 0"), people
    fitted = fit_sparse_one_hot(train, ["kind", "who"], ["v"])
    got = sorted((r["id"], r["prob"]) for r in SL.logistic_scores(fitted, train, score, ["id"], max_iter=6, block_rows=100).collect())
    want = _by_spark(fitted, train, score)
    assert [i for i, _ in got] == [i for i, _ in want] and len(got) == 1550
    assert np.allclose([p for _, p in got], [p for _, p in want], atol=1e-7)


def test_driver_gets_no_vector_as_wide_as_the_categories(spark, people, monkeypatch):
    wide = people.withColumn("who", F.coalesce("who", F.lit(0)) * 100 + F.col("id") % 97)
    fitted = fit_sparse_one_hot(wide, ["kind", "who"], ["v"])
    assert fitted.width > 900
    sizes, real = [], SL._minimise
    monkeypatch.setattr(SL, "_minimise", lambda v, f, x, *rest: sizes.append((v.n, len(x))) or real(v, lambda at: f(at), x, *rest))
    held, grow = [], SL._Vectors.grow
    monkeypatch.setattr(SL._Vectors, "grow", lambda self, products, square: held.append(len(products)) or grow(self, products, square))
    assert SL.logistic_scores(fitted, wide, wide, ["id"], max_iter=2).count() == wide.count()
    assert sizes == [(5, 6)]                             # v, three kinds, the intercept; a factor of the means
    assert held == list(range(1, len(held) + 1)) and len(held) <= 40
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    left = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)
    assert not [s for s in left if s.getPath().getName().startswith("blocks-")]


def test_labels_of_one_kind_and_none(spark):
    rows = [(i, "ab"[i % 2], i, float(i), 1) for i in range(6)]
    df = _table(spark, rows)
    fitted = fit_sparse_one_hot(df, ["kind", "who"], ["v"])
    assert {r["prob"] for r in SL.logistic_scores(fitted, df, df, ["id"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        SL.logistic_scores(fitted, df.withColumn("label", F.when(F.col("id") > 2, 1)), df, ["id"])
    none = df.where("id < 0")
    with pytest.raises(ValueError):
        SL.logistic_scores(fit_sparse_one_hot(none, ["kind", "who"], ["v"]), none, df, ["id"])


def test_the_query_fits_without_whole_vectors(spark, sf, monkeypatch):
    import __spark_entry__ as E

    from fitloom.operators.sparse_onehot import SparseOneHot

    real = SL._minimise
    monkeypatch.setattr(SparseOneHot, "vectors", None)
    monkeypatch.setattr(SL, "_minimise", lambda v, f, x, max_iter, tol: real(v, f, x, 1, tol))
    assert E.queries()["j7_sparse_logistic"](spark, sf).where("prob between 0 and 1").count() == 500
