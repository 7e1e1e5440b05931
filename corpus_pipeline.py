"""Corpus pipeline: documents in, packed token sequences out.

Stages, each on all rows that its predecessor kept: quality rules (rejected documents
go), line dedup (repeated chunks are cut from the texts), near-dedup (one document of each
group stays), mixing to source weights (documents dropped or repeated by whole copies) and
packing (the last: one row per piece). Between stages the rows are written as Parquet in the
shared folder and read again, so a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm.bag_minhash import keep_one
from fitloom.llm.common import scratch, table
from fitloom.llm.line_dedup import dedup_lines
from fitloom.llm.mixing import mixed_documents
from fitloom.llm.packing import pack
from fitloom.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks; n_chars follows the new text, emptied documents stay."""
    out = dedup_lines(docs, report=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in 1024-token sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("mixture", mixture), ("packed", packed)]

# EM, weighted MinHash and tokenising are beyond SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
