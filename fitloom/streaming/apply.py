"""Applying fitted tables to arriving rows with Structured Streaming.

Every *apply* step of a fitted encoder / scaler / binning is stateless: a
stream-static join against the small fitted table or an expression with
literals. So scoring new rows as they land needs no streaming state, and the
same fitted tables serve batch and stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.joins import broadcast_bound, materialize
from fitloom.session import checkpoint_dir


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, max_files: int = 1) -> DataFrame:
    """A file-source stream over a parquet folder (or one file, watched through its folder) with the
    schema of ``like``."""
    import os

    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files)
    if "://" not in path and os.path.isfile(path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def apply_fitted(stream: DataFrame, key: str, table: DataFrame, value: str, out: str, default) -> DataFrame:
    """Stream-static left join of a fitted table + default for unseen keys."""
    t = table.select(F.col(key).alias("__fk"), F.col(value).alias("__fv"))
    t, n = materialize(t)
    t = F.broadcast(t) if n <= broadcast_bound(t) else t
    j = stream.join(t, stream[key] == F.col("__fk"), "left")
    return j.withColumn(out, F.coalesce(F.col("__fv"), F.lit(default))).drop("__fk", "__fv")


def run_to_parquet(stream: DataFrame, name: str) -> DataFrame:
    """Drive the stream to completion into a parquet sink in the shared folder and read the result back.

    The sink is files (exactly-once with the checkpoint), so nothing is collected on the driver.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
