"""Euclidean silhouette and sparse one-hot, against brute force and the dense form."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fitloom.operators import encode as J
from fitloom.operators.kmeans_runs import fit_runs
from fitloom.operators.silhouette import best_number_of_clusters, silhouettes
from fitloom.operators.sparse_onehot import fit_sparse_one_hot


def brute(x, labels):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        same = (labels == labels[i]) & (np.arange(len(x)) != i)
        others = [d[labels == c].mean() for c in set(labels) if c != labels[i]]
        if not same.any() or not others:
            out.append(0.0)
            continue
        a, b = d[same].mean(), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [np.full((80, 2), 4.0)])
    labels = np.column_stack([np.repeat([0, 1, 2, 3], [60, 60, 60, 80]), rng.integers(0, 3, len(x)), np.zeros(len(x), int)])
    rows = [(i, float(a), float(b), *map(int, m)) for i, ((a, b), m) in enumerate(zip(x, labels, strict=True))]
    return x, labels, spark.createDataFrame(rows, "id int, a double, b double, good int, bad int, one int").repartition(3)


def test_silhouette_equals_brute_force(blobs):
    x, labels, df = blobs
    got = {r["clustering"]: r for r in silhouettes(df, ["a", "b"], ["good", "bad", "one"], "id").collect()}
    for i, name in enumerate(("good", "bad", "one")):
        assert got[name]["n"] == len(x) and got[name]["silhouette"] == pytest.approx(brute(x, labels[:, i]), abs=1e-9)


def test_a_sample_scores_every_row(blobs):
    x, labels, df = blobs
    got = {r["clustering"]: r for r in silhouettes(df, ["a", "b"], ["good"], "id", sample=60).collect()}
    assert got["good"]["n"] == len(x) and abs(got["good"]["silhouette"] - brute(x, labels[:, 0])) < 0.05


def test_silhouette_of_nothing_and_of_missing_values(spark, blobs):
    _, _, df = blobs
    assert silhouettes(df.where("id < 0"), ["a", "b"], ["good"], "id").first()["silhouette"] is None
    more = df.unionByName(spark.createDataFrame([(999, None, 1.0, 0, 0, 0), (1000, 1.0, 1.0, None, 0, 0)], df.schema))
    assert silhouettes(more, ["a", "b"], ["good"], "id").first() == silhouettes(df, ["a", "b"], ["good"], "id").first()


def test_best_number_is_the_planted_one(blobs):
    x, _, df = blobs
    board = best_number_of_clusters(df, ["a", "b"], range(2, 7), "id", restarts=4).collect()
    assert [r["k"] for r in board if r["is_best"]] == [4]
    labels = np.array([r["k4"] for r in fit_runs(df, {f"k{k}": (["a", "b"], k) for k in range(2, 7)}, 4).label(df).orderBy("id").collect()])
    scaled = (x - x.mean(0)) / x.std(0)
    assert board[2]["silhouette"] == pytest.approx(brute(scaled, labels), abs=1e-9)


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(5)
    kinds = ["a", "b", "c", "d", "e"]
    rows = [(i, kinds[int(rng.integers(5))], float(rng.normal())) for i in range(600)]
    rows = [(i, k, v, int(v + kinds.index(k) - 2 + rng.normal() > 0)) for i, k, v in rows] + [(600, None, 0.0, 0), (601, "a", None, 1)]
    return spark.createDataFrame(rows, "id int, kind string, v double, label int")


def test_sparse_vectors_are_the_dense_columns(sales, spark):
    fitted = fit_sparse_one_hot(sales, ["kind"], ["v"])
    cats = J.fit_categories(sales, "kind")
    dense = J.one_hot(sales, "kind", cats)
    names = ["v", *[f"kind_{c}" for c in cats[1:]]]
    want = {r["id"]: [r[c] or 0.0 for c in names] for r in dense.collect()}
    got = {r["id"]: list(r["features"].toArray()) for r in fitted.vectors(sales, ["id"]).collect()}
    assert got == want and fitted.width == 5
    unseen = spark.createDataFrame([(1, "zz", 2.0)], "id int, kind string, v double")
    assert list(fitted.vectors(unseen, ["id"]).first()["features"].toArray()) == [2.0, 0.0, 0.0, 0.0, 0.0]
    keep_all = fit_sparse_one_hot(sales, ["kind"], drop_first=False)
    assert keep_all.width == 5 and {r["indices"][0] for r in keep_all.indexed(sales.where("kind = 'a'")).collect()} == {0}


def test_sparse_and_dense_fits_predict_alike(sales):
    def scores(rows):
        model = LogisticRegression(regParam=0.01, standardization=False, tol=1e-10).fit(rows)
        return {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}

    cats = J.fit_categories(sales, "kind")
    dense = J.one_hot(sales.fillna(0.0, ["v"]), "kind", cats)
    dense = VectorAssembler(inputCols=["v", *[f"kind_{c}" for c in cats[1:]]], outputCol="features").transform(dense)
    a, b = scores(fit_sparse_one_hot(sales, ["kind"], ["v"]).vectors(sales, ["id", "label"])), scores(dense)
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_a_hundred_thousand_categories_fit(spark):
    df = spark.range(200_000).select("id", F.concat(F.lit("c"), F.col("id") % 100_000).alias("kind"), (F.col("id") % 2).cast("int").alias("label"))
    fitted = fit_sparse_one_hot(df, ["kind"])
    rows = fitted.vectors(df, ["id", "label"])
    assert fitted.width == 99_999
    model = LogisticRegression(maxIter=5, regParam=1e-6, standardization=False).fit(rows)
    right = model.transform(rows).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert model.numFeatures == 99_999 and right > 0.99


def test_sparse_one_hot_of_an_empty_table(sales):
    fitted = fit_sparse_one_hot(sales.where("id < 0"), ["kind"], ["v"])
    assert fitted.width == 1 and list(fitted.vectors(sales.where("id = 3"), ["id"]).first()["features"].indices) == [0]


def test_multi_k_labels_read_the_written_basket(spark, sf):
    from fitloom.plans.q_cluster import l3_multi_k

    plan = l3_multi_k(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan      # the joins of the basket are not rebuilt for the labels


def test_squared_silhouettes_equal_the_evaluator_and_input_is_read_once(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from fitloom.operators import cluster as L
    from fitloom.operators.squared_silhouette import squared_silhouettes

    rng = np.random.default_rng(5)
    pts = [(float(a), float(b), int(a > 0), int(rng.integers(0, 4)) if i else 4) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    pts += pts[1:30]                                            # copies; label 4 of the second clustering has one row
    df = spark.createDataFrame(pts, "a double, b double, two int, many int").repartition(3)
    got = squared_silhouettes(df, 2)
    for label, value in zip(("two", "many"), got, strict=True):
        rows = df.select(array_to_vector(F.array("a", "b")).alias("features"), F.col(label).cast("double").alias("prediction"))
        assert abs(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows) - value) < 1e-9

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    out = L.silhouette_scan(spark, df.select(counted("a").alias("a"), "b"), ["a", "b"], [2, 3]).collect()
    assert seen.value == len(pts) and sum(r["is_best"] for r in out) == 1 and [r["k"] for r in out] == [2, 3]
