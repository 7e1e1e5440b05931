import __spark_entry__ as E

PLAN_KEYS = ["w3_baseline_features", "g2_group_stats", "j2_smoothed_target", "q5_threshold_scan", "d9_cluster_fill",
             "p7_majority_vote", "b15_log1p", "c9_spend_entropy", "n2_stratified_kfold"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert E.entry(spark).schema == df.schema


def test_no_python_udf_no_cartesian(spark, sf):
    qs = E.queries()
    for k in PLAN_KEYS:
        p = _plan(qs[k](spark, sf))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, k
        assert "CartesianProduct" not in p, k


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    from pyspark.sql import functions as F

    from fitloom.sources.frames import basket

    b = basket(spark, sf).where(F.col("split") == "train")
    p = b.select("id", "age", "sp_economy")._jdf.queryExecution().executedPlan().toString()
    # the lineitem scan reads only the three columns the spend aggregate needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double>" in p
    # nothing of the spend is asked for: its join and scan go
    assert "l_orderkey" not in b.select("id", "age")._jdf.queryExecution().executedPlan().toString()


def test_registry_covers_inventory():
    keys = set(E.queries())
    prefixes = {k.split("_")[0] for k in keys}
    for fam, n in {"a": 6, "b": 25, "c": 11, "d": 15, "e": 4, "f": 10, "g": 10, "h": 5, "i": 3, "t": 3,
                   "j": 8, "k": 2, "l": 6, "m": 7, "n": 5, "o": 9, "q": 11, "r": 4, "w": 7}.items():
        ids = {p for p in prefixes if p[0] == fam and p[1:].rstrip("b").isdigit()}
        assert len(ids) >= n, (fam, sorted(ids))
    assert {f"p{i}" for i in range(1, 19)} <= prefixes


def test_prediction_store_prunes_member_partitions(spark, sf):
    from fitloom.sources import io as A
    from fitloom.sources.frames import preds

    path = A.save_predictions(preds(spark, sf), A.scratch_path(spark, "test_preds"))
    df = A.load_predictions(spark, path, members=[1, 3])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "member" in plan
    assert sorted(r[0] for r in df.select("member").distinct().collect()) == [1, 3]


def test_csv_scan_forces_string_id(spark, sf):
    from fitloom.sources import io as A
    from fitloom.sources.tables import table

    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = A.csv_sink(o, A.scratch_path(spark, "test_csv"))
    back = A.csv_scan(spark, path, "o_orderkey long, o_totalprice double", id_col="o_orderkey")
    assert dict(back.dtypes)["o_orderkey"] == "string" and back.count() == o.count()


def test_submission_read_back(spark, sf):
    from fitloom.operators.ensemble import average_blend
    from fitloom.sources import io as A
    from fitloom.sources.frames import preds

    sub = A.write_submission(average_blend(preds(spark, sf)), "row_id", "pred", A.scratch_path(spark, "test_sub"))
    assert sub.dtypes == [("id", "string"), ("pred", "boolean")]


def test_stack_reads_written_member_scores(spark, sf, monkeypatch):
    from fitloom.plans import flows

    plans, made = [], flows.S.oof_predictions

    def recorded(train, test, kinds, *rest, **kw):
        plans.append(test._jdf.queryExecution().optimizedPlan().toString())
        return made(train, test, kinds, *rest, **kw)

    monkeypatch.setattr(flows.S, "oof_predictions", recorded)
    flows.leakage_aware_stack(spark, sf)
    assert len(plans) == 2 and all("RDD" in p and "UDF" not in p for p in plans)


def test_stack_keeps_only_the_tables_that_later_steps_read(spark, sf, monkeypatch):
    import pytest

    from fitloom.plans import flows
    from fitloom.session import checkpoint_dir

    class Fitting(Exception):
        pass

    sc = spark.sparkContext
    checkpoint_dir(spark)

    def kept():
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        return {s.getPath().getName() for s in path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)}

    def members(train, test, kinds, feats, *rest):
        assert not {"route", "max_category", "segment", "grp", "split"} & set(train.columns + test.columns)
        assert train.count() and test.count()
        raise Fitting

    monkeypatch.setattr(flows.S, "oof_predictions", members)
    before = kept()
    with pytest.raises(Fitting):
        flows.leakage_aware_stack(spark, sf)
    assert len({x for x in kept() - before if x.startswith("rdd-")}) == 2        # the training and the test rows


def test_forgotten_frames_leave_no_files(spark):
    import os

    from fitloom.session import cut_lineage, forget, shuffles_freed

    with shuffles_freed(spark):
        a = cut_lineage(spark.range(100).repartition(3))
        b = cut_lineage(a.selectExpr("id + 1 as id"))
    file = a._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(file)
    forget(a, spark.range(3).toDF("id"))
    assert not os.path.exists(file) and b.agg({"id": "sum"}).first()[0] == 5050
