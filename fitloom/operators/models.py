"""Classifiers on Spark ML (O1-O9) and cross-validated evaluation helpers.

Models train with Spark ML's distributed estimators; fold loops iterate over
model fits (k small), never over data rows. The feature frame is
checkpointed to the shared checkpoint folder before fold / seed loops so the
lineage stays short and a lost executor recomputes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import metrics as Q
from fitloom.operators.concurrent import run_fits


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def classifier(kind: str, seed: int = 42, label: str = "label", n_features: int | None = None,
               n_rows: int | None = None, **kw):
    """Spark ML estimator for one reference model family.

    ``C`` (default 1) is the inverse penalty on the summed loss; Spark penalises the
    mean loss, so ``regParam = 1 / (C * n_rows)`` on the unscaled coefficients.
    """
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "lr":                                   # O1
        reg = kw.get("regParam", 1.0 / (kw.get("C", 1.0) * max(n_rows or 1, 1)))
        return LogisticRegression(maxIter=kw.get("maxIter", 100), regParam=reg, standardization=False, **common)
    if kind == "gbt":                                  # O2 / O3
        g = GBTClassifier(maxIter=kw.get("maxIter", 20), maxDepth=kw.get("maxDepth", 3),
                          stepSize=kw.get("stepSize", 0.1), subsamplingRate=kw.get("subsamplingRate", 1.0),
                          featureSubsetStrategy=kw.get("featureSubsetStrategy", "all"),
                          minInstancesPerNode=kw.get("minInstancesPerNode", 1), maxBins=kw.get("maxBins", 32),
                          validationTol=kw.get("validationTol", 0.01), seed=seed, **common)
        if kw.get("validationIndicatorCol"):
            g = g.setValidationIndicatorCol(kw["validationIndicatorCol"])
        return g
    if kind == "rf":                                   # O4
        return RandomForestClassifier(numTrees=kw.get("numTrees", 50), maxDepth=kw.get("maxDepth", 6),
                                      seed=seed, **common)
    if kind == "xt":                                   # O5: no bootstrap, one third of features per split
        return RandomForestClassifier(numTrees=kw.get("numTrees", 50), maxDepth=kw.get("maxDepth", 6),
                                      bootstrap=False, featureSubsetStrategy="onethird", seed=seed, **common)
    if kind == "mlp":                                  # O6
        hidden = list(kw.get("hidden", [16, 8]))
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=kw.get("maxIter", 100),
                                              seed=seed, **common)
    raise ValueError(kind)


def fitted_pipeline(train: DataFrame, kind: str, features: Sequence[str], label: str = "label", seed: int = 42, **kw):
    """Assemble, scale where the family needs it (neural net: zero mean, unit variance) and fit."""
    n_rows = train.count() if kind == "lr" else None
    est = classifier(kind, seed, label, n_features=len(features), n_rows=n_rows, **kw)
    if kind == "mlp":
        scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        return Pipeline(stages=[assembler(features, "raw_features"), scale, est]).fit(train)
    return Pipeline(stages=[assembler(features), est]).fit(train)


def positive_prob(pred: DataFrame, col: str = "probability") -> DataFrame:
    return pred.withColumn("prob", vector_to_array(F.col(col))[1])


def fit_predict(train: DataFrame, score: DataFrame, kind: str, features: Sequence[str], label: str = "label",
                seed: int = 42, keep: Sequence[str] = ("row_id",), **kw) -> DataFrame:
    """Fit on ``train``; return ``keep`` + prob + pred for ``score`` rows."""
    model = fitted_pipeline(train, kind, features, label, seed, **kw)
    out = positive_prob(model.transform(score))
    return out.select(*keep, F.round("prob", 12).alias("prob"), (F.col("prob") > 0.5).cast("int").alias("pred"))


def fit_model(train: DataFrame, kind: str, features: Sequence[str], label: str = "label", seed: int = 42, **kw):
    return fitted_pipeline(train, kind, features, label, seed, **kw)


# O7 ---------------------------------------------------------------------------
def ridge_classify(train: DataFrame, score: DataFrame, features: Sequence[str], label: str = "label",
                   alpha: float = 1.0, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Ridge classifier: L2 least squares on labels mapped to -1/+1; predict the sign."""
    t = train.withColumn("__pm", F.col(label) * 2.0 - 1.0)
    size = t.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__pm").alias("sd")).first()
    # Spark penalises the mean squared error of the label in units of its deviation
    reg = alpha / max(size["n"], 1) * (size["sd"] or 1.0)
    lr = LinearRegression(featuresCol="features", labelCol="__pm", regParam=reg, elasticNetParam=0.0, solver="normal",
                          standardization=False)
    model = Pipeline(stages=[assembler(features), lr]).fit(t)
    out = model.transform(score)
    return out.select(*keep, F.round("prediction", 12).alias("margin"), (F.col("prediction") > 0).cast("int").alias("pred"))


# O8 ---------------------------------------------------------------------------
def calibrate_sigmoid(fit_on: DataFrame, score: DataFrame, margin: str, label: str = "label",
                      keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Platt scaling of an already fitted score: one-feature logistic regression on the margin.

    Targets are smoothed: (n1 + 1) / (n1 + 2) for the n1 positives and 1 / (n0 + 2) for the n0 negatives, as two
    weighted rows of either class per row.
    """
    rows = fit_on.where(F.col(label).isNotNull() & F.col(margin).isNotNull())
    n = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    target = F.when(F.col(label) == 1, F.lit((n["p"] + 1.0) / (n["p"] + 2.0))).otherwise(F.lit(1.0 / (n["n"] + 2.0)))
    both = F.array(F.struct(F.lit(1.0).alias("__y"), target.alias("__w")), F.struct(F.lit(0.0).alias("__y"), (1.0 - target).alias("__w")))
    weighted = rows.select(margin, F.explode(both).alias("__b")).select(margin, "__b.*")
    model = Pipeline(stages=[assembler([margin], "features"), LogisticRegression(
        featuresCol="features", labelCol="__y", weightCol="__w", standardization=False, tol=1e-10, maxIter=200)]).fit(weighted)
    out = positive_prob(model.transform(score))
    return out.select(*keep, F.round("prob", 12).alias("prob_calibrated"))


# O9 ---------------------------------------------------------------------------
def importance_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


# cross-validation ----------------------------------------------------------------
def cv_metric(df: DataFrame, fold: str, k: int, fit_score: Callable[[DataFrame, DataFrame], DataFrame],
              label: str = "label", metric: str = "auc") -> list[float]:
    """Per-fold metric of ``fit_score(train_part, valid_part) -> (label, prob, pred)``."""
    return cv_metrics(df, fold, k, {"": fit_score}, label, metric)[""]


def cv_metrics(df: DataFrame, fold: str, k: int, scorers: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]],
               label: str = "label", metric: str = "auc") -> dict[str, list[float]]:
    """Per-fold metrics of each scorer; the fits of all scorers and folds run side by side."""
    def value(name: str, f: int) -> float:
        sc = scorers[name](df.where(F.col(fold) != f), df.where(F.col(fold) == f))
        if metric == "auc":
            return Q.auc(sc, label, "prob").first()["auc"]
        return sc.agg(F.avg((F.col(label) == F.col("pred")).cast("double")).alias("a")).first()["a"]

    found = run_fits(df.sparkSession, {(name, f): partial(value, name, f) for name in scorers for f in range(k)})
    return {name: [found[name, f] for f in range(k)] for name in scorers}
