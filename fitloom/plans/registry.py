"""Registry of named queries (Spark callables) and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with an optional oracle."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself on import)."""
    import importlib

    for mod in ("q_sources", "q_scalar", "q_groups", "q_relate", "q_encode", "q_impute",
                "q_blend", "q_cluster", "q_models", "q_flows"):
        importlib.import_module(f"fitloom.plans.{mod}")
