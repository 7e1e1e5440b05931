"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.session import checkpoint_dir

# White space is the space and U+0009..U+000D, a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# shuffle files are deleted when the query that wrote them ends, not only when the driver collects garbage
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: every executor reads the same files, so a lost executor
    costs the re-read of its splits and no recomputation. The table is deleted when the driver
    ends; a driver that is killed leaves it in the folder that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = _scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Only a folder that exists is deleted when the driver ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def scratch_by(df: DataFrame, label: str, key: str, compression: str = "zstd") -> DataFrame:
    """``scratch`` in buckets by ``key``, by which ``df`` is dealt already: joins and groupings by ``key`` move no row of it again.

    An external table of the session's catalog, with a name of its own; its files go as those of ``scratch``.
    """
    spark = df.sparkSession
    path = _scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.bucketBy(shuffle_partitions(spark), key).option("path", path).option("compression", compression).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    _delete_at_end(spark, path)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """Uniform double in (0, 1) from the MD5 of ``cols`` (strings; NULL as empty); the same in every run and engine."""
    text = F.concat_ws("#", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def local_rows(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small table of numbers as a literal relation: no Python rows travel to executors."""
    names = ", ".join(n for n, _ in schema)
    if not rows:
        return spark.sql("select " + ", ".join(f"cast(null as {t}) {n}" for n, t in schema) + " where false")
    values = ", ".join("(" + ", ".join(f"cast({v!r} as {t})" for v, (_, t) in zip(r, schema, strict=True)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({names})")


def keep_listed(df: DataFrame, listed: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a long) is in ``listed``.

    The list is broadcast when it is counted at no more than ``broadcast_rows`` (16 bytes each);
    beyond that it is a shuffle join with the same rows.
    """
    small = listed.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(listed) if small else listed, key, "left_semi")
