"""Choosing among whole configurations, and searching parameters over continuous ranges.

A configuration is one or more members (model family, parameters), the features that they see, and how they vote. All
members that configurations share, on the same features, are fitted once per fold, side by side. Their out-of-fold
predictions are one long table; a broadcast table of (member, configuration, weight), a row per named member, turns
it into the votes of every configuration by one aggregate per row, and into accuracies by a second.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators.concurrent import run_fits
from fitloom.operators.metrics import auc_by
from fitloom.operators.models import cv_metrics, fit_predict
from fitloom.session import cut_lineage


@dataclass(frozen=True)
class Config:
    """``members`` maps a name to (family, parameters); ``vote`` is soft (weighted mean probability over 0.5) or
    hard (weighted majority of the members' predictions, a tie is 0)."""

    members: Mapping[str, tuple[str, dict]]
    features: Sequence[str]
    vote: str = "soft"
    weights: Mapping[str, float] | None = None


def out_of_fold_votes(spark: SparkSession, df: DataFrame, configs: Mapping[str, Config], fold: str, k: int, label: str = "label",
                      key: str = "row_id") -> DataFrame:
    """(config, fold, key, label, score, pred): each configuration's out-of-fold vote for every row of ``df``."""
    df = cut_lineage(df)
    fitted: dict[tuple, int] = {}
    uses = []
    for name, config in configs.items():
        if config.vote not in ("soft", "hard"):
            raise ValueError(f"{name}: vote must be soft or hard, not {config.vote}")
        for member, (kind, params) in config.members.items():
            what = (kind, tuple(sorted(params.items())), tuple(config.features))
            place = fitted.setdefault(what, len(fitted))
            uses.append((place, name, float((config.weights or {}).get(member, 1.0)), config.vote == "soft"))
    keep = (key, label, fold)
    scored = run_fits(spark, {(place, f): partial(fit_predict, df.where(F.col(fold) != f), df.where(F.col(fold) == f), kind, list(features), label,
                                                  keep=keep, **dict(params))
                              for (kind, params, features), place in fitted.items() for f in range(k)})
    long = None
    for (place, _), part in scored.items():
        part = part.withColumn("__member", F.lit(place))
        long = part if long is None else long.unionByName(part)
    table = spark.createDataFrame(uses, "__member int, config string, __w double, __soft boolean")
    voted = long.join(F.broadcast(table), "__member")       # a row per (configuration, member) that was named
    ballot = F.when(F.col("__soft"), F.col("prob")).otherwise(F.col("pred").cast("double"))
    out = voted.groupBy("config", fold, key, label).agg(F.round(F.sum(F.col("__w") * ballot) / F.sum("__w"), 12).alias("score"))
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def compare_configs(spark: SparkSession, df: DataFrame, configs: Mapping[str, Config], fold: str, k: int, label: str = "label",
                    metric: str = "accuracy", key: str = "row_id") -> DataFrame:
    """(config, cv_mean, cv_std, is_best): population deviation over folds; ties go to the configuration named first."""
    votes = out_of_fold_votes(spark, df, configs, fold, k, label, key)
    if metric == "auc":
        per = auc_by(cut_lineage(votes), label, "score", ["config", fold]).select("config", F.col("auc").alias("m"))
    else:
        per = votes.groupBy("config", fold).agg(F.avg((F.col(label) == F.col("pred")).cast("double")).alias("m"))
    found = {r["config"]: r for r in per.groupBy("config").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")).collect()}
    rows = [(name, round(found[name]["mean"], 12), round(found[name]["std"], 12)) for name in configs]
    best = max(rows, key=lambda r: r[1])[0]
    return spark.createDataFrame([(*r, int(r[0] == best)) for r in rows], "config string, cv_mean double, cv_std double, is_best int")


def draw(ranges: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``n`` parameter sets. A range is ("uniform", lo, hi), ("log", lo, hi), ("int", lo, hi) with both ends, or ("of", values)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        params = {}
        for name, (kind, *ends) in ranges.items():
            if kind == "uniform":
                params[name] = rng.uniform(*ends)
            elif kind == "log":
                params[name] = ends[0] * (ends[1] / ends[0]) ** rng.random()
            elif kind == "int":
                params[name] = rng.randint(*ends)
            elif kind == "of":
                params[name] = rng.choice(list(ends[0]))
            else:
                raise ValueError(f"{name}: unknown range {kind}")
        out.append(params)
    return out


def search_ranges(spark: SparkSession, df: DataFrame, kind: str, ranges: Mapping[str, tuple], features: Sequence[str], fold: str, k: int,
                  n_iter: int = 10, label: str = "label", metric: str = "auc", seed: int = 42) -> DataFrame:
    """Random search: one row per draw (draw, params, cv_mean, cv_std, is_best), all fits side by side; ties go to the first draw."""
    df = cut_lineage(df)

    def scorer(tr: DataFrame, va: DataFrame, params: dict) -> DataFrame:
        return fit_predict(tr, va, kind, features, label, seed, keep=("row_id", label), **params)

    sets = draw(ranges, n_iter, seed)
    found = cv_metrics(df, fold, k, {str(i): partial(scorer, params=p) for i, p in enumerate(sets)}, label, metric)
    rows = []
    for i, params in enumerate(sets):
        v = found[str(i)]
        mean = sum(v) / len(v)
        rows.append((i, {name: float(x) for name, x in params.items()}, float(mean), float((sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5)))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return spark.createDataFrame([(*r, int(r[0] == best)) for r in rows],
                                 "draw int, params map<string,double>, cv_mean double, cv_std double, is_best int")
