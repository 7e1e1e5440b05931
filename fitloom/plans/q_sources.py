"""Queries for sources and sinks (A1-A6) and the streaming apply path."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.operators import encode as J
from fitloom.operators import ensemble as EN
from fitloom.operators import folds as N
from fitloom.plans.registry import register
from fitloom.plans.sqlframes import with_frames
from fitloom.sources import io as A
from fitloom.sources.frames import basket, line, preds
from fitloom.sources.tables import table
from fitloom.streaming import apply as S


@register("a1_csv_scan", with_frames("basket", """
SELECT CAST(id AS VARCHAR) AS id, age, planet, dest, sp_economy, label FROM basket"""))
def a1_csv_scan(spark, sf):
    b = basket(spark, sf).select("id", "age", "planet", "dest", "sp_economy", "label")
    path = A.csv_sink(b, A.scratch_path(spark, "basket_csv"))
    return A.csv_scan(spark, path, "id long, age double, planet string, dest string, sp_economy double, label int",
                      id_col="id")


@register("a2_csv_sink", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice FROM lineitem""")
def a2_csv_sink(spark, sf):
    li = line(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")
    path = A.csv_sink(li, A.scratch_path(spark, "line_csv"))
    return A.csv_scan(spark, path, li.schema)


@register("a3_prediction_store", with_frames("preds", "SELECT row_id, member, prob, vote FROM preds WHERE member IN (0, 2)"))
def a3_prediction_store(spark, sf):
    path = A.save_predictions(preds(spark, sf), A.scratch_path(spark, "preds"))
    return A.load_predictions(spark, path, members=[0, 2]).select("row_id", "member", "prob", "vote")


_P5 = """p5 AS (SELECT row_id, round(avg(prob), 12) AS prob_mean FROM preds GROUP BY row_id)"""


@register("a4_submission", with_frames("preds", f"""
{_P5} SELECT CAST(row_id AS VARCHAR) AS id, prob_mean > 0.5 AS pred FROM p5"""))
def a4_submission(spark, sf):
    blend = EN.average_blend(preds(spark, sf))
    return A.write_submission(blend, "row_id", "pred", A.scratch_path(spark, "submission"))


@register("a4_submission_text", with_frames("preds", f"""
{_P5} SELECT CAST(row_id AS VARCHAR) AS id, CASE WHEN prob_mean > 0.5 THEN 'true' ELSE 'false' END AS pred FROM p5"""))
def a4_submission_text(spark, sf):
    blend = EN.average_blend(preds(spark, sf))
    return A.write_submission(blend, "row_id", "pred", A.scratch_path(spark, "submission_txt"), lower_text=True)


@register("a5_reattach_ids", with_frames("basket preds", f"""
{_P5} SELECT id, CAST(prob_mean > 0.5 AS INTEGER) AS pred FROM basket JOIN p5 ON id = row_id WHERE split = 'test'"""))
def a5_reattach_ids(spark, sf):
    test = basket(spark, sf).where(F.col("split") == "test").select("id")
    test = N.ordered_position(test.withColumn("__h", N.md5_of("id")), "__h", out="ordinal").drop("__h")
    blend = EN.average_blend(preds(spark, sf)).select(F.col("row_id").alias("id"), "pred")
    carried = test.join(blend, "id").drop("id")          # prediction file: (ordinal, pred), ids lost
    return A.reattach_ids(test, carried)


_COLS = ["id", "grp", "age", "planet", "dest", "sp_economy", "sp_large", "sp_medium", "sp_promo", "sp_small",
         "state", "state_n", "vip", "label", "split", "age_n", "planet_n"]
_DTYPES = {"bigint": 2, "boolean": 3, "double": 7, "int": 1, "string": 4}


@register("a6_quality_report", with_frames("basket", "SELECT 'shape' AS section, 'rows' AS item, count(*) AS value FROM basket"
    + "".join(f" UNION ALL SELECT 'nulls', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM basket" for c in _COLS)
    + f" UNION ALL SELECT 'shape', 'columns', {len(_COLS)}"
    + "".join(f" UNION ALL SELECT 'dtypes', '{k}', {v}" for k, v in _DTYPES.items())
    + " UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM basket GROUP BY label"))
def a6_quality_report(spark, sf):
    return A.quality_report(basket(spark, sf), "label")


@register("s1_stream_apply_encoder", """
WITH f AS (SELECT o_orderpriority, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderkey % 3 <> 0) AS freq
           FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT o_orderkey, o_orderpriority, coalesce(freq, 0.0) AS priority_freq FROM orders LEFT JOIN f USING (o_orderpriority)""")
def s1_stream_apply_encoder(spark, sf):
    """Fit a frequency encoder on the batch training rows, apply it to orders arriving as a stream."""
    orders = table(spark, sf, "orders")
    train = orders.where(F.col("o_orderkey") % 3 != 0)
    fitted, _ = J.fit_frequency(train, "o_orderpriority")
    stream = S.parquet_stream(spark, f"{sf.rstrip('/')}/orders.parquet", orders)
    scored = S.apply_fitted(stream.select("o_orderkey", "o_orderpriority"), "o_orderpriority", fitted, "freq",
                            "priority_freq", 0.0)
    return S.run_to_parquet(scored, "orders_scored")
