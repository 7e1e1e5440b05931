"""Boosted trees that stop with patience and keep their best round (O3).

The ensemble is fitted for ``rounds`` rounds; one pass over the validation rows gives the loss of every
prefix of it. Going through the rounds, the best one so far is kept until ``patience`` rounds bring
nothing better; the ensemble is then cut after it. Rounds do not depend on later ones, so this is the model
that stopping while fitting would have left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators.models import fitted_pipeline


def staged_losses(model: PipelineModel, valid: DataFrame, label: str = "label") -> list[float]:
    """Validation loss (twice the log loss of the margin) of the first 1, 2, 3, ... trees, in one pass."""
    rows = model.stages[0].transform(valid.where(F.col(label).isNotNull())).select("features", F.col(label).cast("double").alias(label))
    return [float(v) for v in model.stages[-1].evaluateEachIteration(rows)]


def best_round(losses: Sequence[float], patience: int) -> int:
    """Number of rounds to keep: the best one (the first of equals) before ``patience`` rounds without gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cut_ensemble(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The same model with its first ``rounds`` trees only."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    jvm, old = sc._jvm, model._java_obj
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(old.trees()[:rounds], model.treeWeights[:rounds], strict=True)):
        trees[i], weights[i] = tree, float(weight)
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(old.uid(), trees, weights)
    return GBTClassificationModel(old.copy(old.extractParamMap()).extractParamMap() and _with_params(made, old))


def _with_params(made, old):
    for name in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        param = old.getParam(name)
        made.set(made.getParam(name), old.getOrDefault(param))
    return made


def fit_with_patience(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 200,
                      patience: int = 50, seed: int = 42, **kw) -> tuple[PipelineModel, list[float], int]:
    """(model cut at its best round, validation loss of every round, rounds kept)."""
    model = fitted_pipeline(train, "gbt", features, label, seed, maxIter=rounds, **kw)
    losses = staged_losses(model, valid, label)
    kept = best_round(losses, patience)
    return PipelineModel(stages=[model.stages[0], cut_ensemble(model.stages[-1], kept)]), losses, kept


def loss_table(spark: SparkSession, losses: Sequence[float], kept: int) -> DataFrame:
    """(round, loss, kept, is_best): the course of the validation loss."""
    return spark.createDataFrame([(i + 1, v, int(i < kept), int(i + 1 == kept)) for i, v in enumerate(losses)],
                                 "round int, loss double, kept int, is_best int")
