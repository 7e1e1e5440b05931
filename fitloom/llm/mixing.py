"""Mixing sources to target weights by Efraimidis-Spirakis sampling [native].

Sources in code point order (NULL last) get the weights 5, 2, 1, repeating, of a budget
of ``budget_share`` times all words. A target is cut at ``max_epochs`` times its source's
size and what is cut off is shared again by weight: the fixed point of that is
``min(max_epochs * size, level * weight)`` with one ``level`` for all sources, read off
the sources sorted by ``size / weight``.

A source is taken in whole epochs first. What is left of its target is a weighted
sample without replacement: every document draws the exponential key
``-ln(u) / quality`` (u from a hash of its id and text, so reruns agree), the source is
sorted by key, and documents are taken while the running sum of words stays within
the budget (the document at the border goes to the nearer side).

The running sum needs no whole source in one task: words are summed per (source, key
bucket), the bucket at the border is found from the bucket sums, and only that bucket's
rows are sorted. Only the table of sources (one row each) meets in one task.

Edge cases: NULL or empty text has size 0 and takes 0; a NULL source is a source of its
own; ties in the key go by doc_id, then size; rows that repeat in id and text draw the
same key and stand in a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import scratch, unit_hash, word_count

# The weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
KEY_BUCKETS = 65_536


def quality_weight(text: Column) -> Column:
    """Weight in [0.05, 1]: falls with the share of symbol characters per word."""
    words = F.greatest(word_count(text), F.lit(1))
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>{}]")), F.lit(0))
    return F.greatest(F.lit(0.05), 1.0 - symbols / words)


def source_targets(sizes: DataFrame, budget_share: float = 1.5, max_epochs: int = 2,
                   weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> source, source_size, target. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = (t.withColumn("spent", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("budget", F.sum(F.col("source_size").cast("double")).over(every) * budget_share)
         .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open_w"))
         .withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
         .withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(every)["level"]))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, budget_share: float = 1.5, max_epochs: int = 2,
        keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns, doc_id alone by default), size, source_size, target, taken and
    times (copies the mix takes) for every row."""
    text = F.col("text")
    rows = scratch(docs.select(
        F.struct(*[F.col(c) for c in keep or ["doc_id"]]).alias("row"), "doc_id", "source", word_count(text).alias("size"),
        F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), unit_hash(F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")))).alias("u"),
        (quality if quality is not None else quality_weight(text)).alias("quality")),
        "mix-rows", "zstd" if keep else "snappy")
    rows = (rows.withColumn("key", -F.log("u") / F.coalesce("quality", F.lit(0.05)))
            # 1 - exp(-key) keeps the order of the keys and spreads them over (0, 1)
            .withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int")))
    sums = scratch(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), budget_share, max_epochs)
    plan = (targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (sums.withColumn("upto", F.sum("words").over(running))
              .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
              .where(F.col("upto") > F.col("rest"))
              .groupBy(F.col("source").alias("b")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
              .select("b", F.col("x.bucket").alias("border"), "x.before"))
    # one row per source: the size of the source table, checked by Spark's broadcast threshold
    plan = scratch(plan.join(border, F.col("source").eqNullSafe(F.col("b")), "left")
                   .select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest",
                           F.coalesce("border", F.lit(KEY_BUCKETS)).alias("border"), F.coalesce("before", F.lit(0)).alias("before")), "mix-plan")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    sorted_up = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at_border = (rows.where(F.col("bucket") == F.col("border"))
                 .withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(sorted_up), F.lit(0)))
                 .withColumn("more", (F.col("upto") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto"))
    others = rows.where(F.col("bucket") != F.col("border")).withColumn("more", (F.col("bucket") < F.col("border")).cast("int"))
    # a third epoch never comes: whole epochs use up a target that is a multiple of the size
    times = F.least(F.col("epochs") + F.col("more"), F.lit(max_epochs)).cast("int")
    return others.unionByName(at_border).select(
        "row", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.alias("times"))


def mixed_documents(docs: DataFrame, budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, with the columns of ``docs``."""
    taken = mix(docs, budget_share=budget_share, max_epochs=max_epochs, keep=docs.columns).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
