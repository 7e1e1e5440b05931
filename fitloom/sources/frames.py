"""Canonical entity frames built from the driver tables.

* ``basket`` - one row per order, shaped like an entity table with a group key,
  a numeric "age", two enums, five nullable spend columns, two flags, a label
  and a train/test split.
* ``line`` - one row per line item, grouped by order (many small groups).
* ``preds`` - a long member x row prediction table with fixed scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.sources.tables import table

# The part types that become spend columns, and their column names.
SPEND_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
SPEND_COLS = ["sp_economy", "sp_large", "sp_medium", "sp_promo", "sp_small"]
N_MEMBERS = 5


def spend_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order x part-type spend as conditional sums: one hash aggregate keyed by order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    aggs = [F.round(F.sum(F.when(F.col("p_type") == t, F.col("l_extendedprice"))), 2).alias(c)
            for t, c in zip(SPEND_TYPES, SPEND_COLS)]
    return joined.groupBy("l_orderkey").agg(*aggs)


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimension tables.
    geo = (table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"),
                                               F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    spend = spend_by_order(spark, sf_dir)
    b = (orders.join(spend, orders.o_orderkey == spend.l_orderkey, "left")
         .join(cust, orders.o_custkey == cust.c_custkey, "left")
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    total = sum_coalesced([F.col(c) for c in SPEND_COLS])
    key = F.col("o_orderkey")
    return b.select(
        key.alias("id"),
        F.col("o_custkey").alias("grp"),
        F.col("c_acctbal").alias("age"),
        F.col("c_mktsegment").alias("planet"),
        F.col("r_name").alias("dest"),
        *[F.col(c) for c in SPEND_COLS],
        (total == 0).alias("state"),
        F.when(key % 11 == 0, F.lit(None).cast("boolean")).otherwise(total == 0).alias("state_n"),
        (F.col("o_orderpriority") == "1-URGENT").alias("vip"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(key % 3 == 0, "test").otherwise("train").alias("split"),
        F.when(key % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("age_n"),
        F.when(key % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("planet_n"),
    )


def sum_coalesced(cols):
    out = None
    for c in cols:
        t = F.coalesce(c, F.lit(0.0))
        out = t if out is None else out + t
    return out


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, member, prob, vote) with a fixed integer-hash score per member and order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    o = o.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(N_MEMBERS - 1))).alias("member"))
    m = F.col("member").cast("long")
    k = F.col("row_id")
    score = (k * 7919 + m * m * 104729 + (k % (m + 3)) * 211) % 1000
    prob = score.cast("double") / 1000.0
    return o.select("row_id", F.col("member").cast("int").alias("member"),
                    prob.alias("prob"), (prob >= 0.5).cast("int").alias("vote"))


# Text features over whole documents (JVM regex functions, no UDF).
DOC_FEATURES = ["log_len", "odd_share", "digit_share", "upper_share", "line_count", "lang_code", "source_code"]


def documents_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with numeric text features. Rows to fit on (split ``train``) are four in five of the
    labelled ones by md5 order, label = quality; every other document, labelled or not, is to be scored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.greatest(F.length("text"), F.lit(1))
    # whole runs are removed, not character by character: the same text is left
    feats = d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "toxic",
        F.log1p(F.length("text")).alias("log_len"),
        (F.length(F.regexp_replace("text", "[a-zA-Z0-9 ]+", "")) / n).alias("odd_share"),
        (F.length(F.regexp_replace("text", "[^0-9]+", "")) / n).alias("digit_share"),
        (F.length(F.regexp_replace("text", "[^A-Z]+", "")) / n).alias("upper_share"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double").alias("line_count"),
        "lang", "source")
    from fitloom.operators.encode import fit_ordinal

    lang_t = fit_ordinal(feats, "lang").select("lang", F.col("code").cast("double").alias("lang_code"))
    src_t = fit_ordinal(feats, "source").select("source", F.col("code").cast("double").alias("source_code"))
    out = (feats.join(lang_t, "lang", "left").join(src_t, "source", "left")
           .fillna(-1.0, ["lang_code", "source_code"]).fillna(0.0, ["log_len", "odd_share", "digit_share", "upper_share"])
           .fillna(1.0, ["line_count"]))
    h = F.md5(F.col("row_id").cast("string"))
    return out.withColumn("split", F.when(F.col("label").isNull() | (F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 5 == 0), "test")
                          .otherwise("train"))
