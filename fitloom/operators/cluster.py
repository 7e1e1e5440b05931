"""Clustering (L1-L6) on Spark ML, and nearest-centroid assignment as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators.encode import fit_robust
from fitloom.operators.squared_silhouette import squared_silhouettes
from fitloom.session import keep_for_reuse


def _vector(features: Sequence[str], scale: bool = True, out: str = "features"):
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scale else out, handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol=out, withMean=True, withStd=True))
    return stages


# L1 / L3 ------------------------------------------------------------------------
def kmeans_fit(train: DataFrame, features: Sequence[str], k: int, seed: int = 42, scale: bool = True,
               max_iter: int = 20):
    return Pipeline(stages=[*_vector(features, scale), KMeans(k=k, seed=seed, maxIter=max_iter,
                                                              featuresCol="features", predictionCol="cluster")]).fit(train)


def kmeans_label(train: DataFrame, df: DataFrame, features: Sequence[str], k: int, out: str = "cluster",
                 seed: int = 42, scale: bool = True) -> DataFrame:
    """Fit k-means on ``train`` and label every row of ``df``."""
    model = kmeans_fit(train, features, k, seed, scale)
    return model.transform(df).withColumnRenamed("cluster", out).drop("features", "__raw")


def multi_k(train: DataFrame, df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    out = df
    for k in ks:
        out = kmeans_label(train, out, features, k, f"km{k}", seed)
    return out


# L2 ---------------------------------------------------------------------------
def nearest_centroid(cols: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the closest literal centre (squared Euclidean, first wins ties): no join."""
    dists = []
    for c in centres:
        d = None
        for col, v in zip(cols, c):
            t = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            d = t if d is None else d + t
        dists.append(d)
    best = F.least(*dists)
    expr = F.lit(len(centres) - 1)
    for i in reversed(range(len(centres) - 1)):
        expr = F.when(dists[i] == best, F.lit(i)).otherwise(expr)
    return expr


# L4 ---------------------------------------------------------------------------
def multiview(train: DataFrame, df: DataFrame, views: Sequence[tuple[str, Sequence[str], int]],
              seed: int = 42) -> DataFrame:
    """One k-means per (name, features, k) view on robust-scaled features (median / IQR fitted on train)."""
    out, fit_frame = df, train
    for name, feats, k in views:
        params = fit_robust(train, feats)
        scaled = {f"__{name}_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()}
        fit_frame = fit_frame.withColumns(scaled)
        out = out.withColumns(scaled)
        cols = list(scaled)
        model = kmeans_fit(fit_frame, cols, k, seed, scale=False)
        out = model.transform(out).withColumnRenamed("cluster", f"cl_{name}").drop("features", *cols)
    return out


# L5 ---------------------------------------------------------------------------
def bisecting_label(train: DataFrame, df: DataFrame, features: Sequence[str], k: int = 12, seed: int = 42,
                    out: str = "cl_hier") -> DataFrame:
    """Hierarchical (divisive) segments: Ward linkage needs all pairs; bisecting k-means does not."""
    model = Pipeline(stages=[*_vector(features), BisectingKMeans(k=k, seed=seed, featuresCol="features",
                                                                 predictionCol=out)]).fit(train)
    return model.transform(df).drop("features", "__raw")


# L6 ---------------------------------------------------------------------------
def silhouette_scan(spark: SparkSession, df: DataFrame, features: Sequence[str], ks: Sequence[int],
                    seed: int = 42) -> DataFrame:
    """Silhouette (squared Euclidean) per k over the whole frame; one row per k.

    The features and then the labels of all k are written once: each fit holds its points in the form it works on, and two
    passes over plain numbers score all k.
    """
    held = df.select(*features).cache()         # k-means draws its centres by partition: these are the ones of a cached table
    df = keep_for_reuse(held)
    held.unpersist()
    prep = keep_for_reuse(Pipeline(stages=_vector(features)).fit(df).transform(df).select("features"))
    models = [KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"__k{i}").fit(prep) for i, k in enumerate(ks)]
    x = vector_to_array("features")
    labelled = PipelineModel(stages=models).transform(prep).select(
        *[F.get(x, i).alias(f"__x{i}") for i in range(len(features))], *[f"__k{i}" for i in range(len(ks))])
    rows = list(zip(map(int, ks), squared_silhouettes(keep_for_reuse(labelled), len(features)), strict=True))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(k, s, int(k == best)) for k, s in rows], "k int, silhouette double, is_best int")
