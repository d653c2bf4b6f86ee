"""Scans, sinks, layout, required columns, split_target and model persistence."""

import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models, profiling, sampling
from riskloom.sources import tables
from riskloom.sources.fixtures import fixture

from conftest import SF001


def test_write_read_csv_and_parquet(spark):
    df = fixture(spark, SF001, "fx_ieee").select("TransactionID", "TransactionAmt", "ProductCD")
    base = tempfile.mkdtemp(prefix="rl-tab-", dir="/tmp")
    tables.write_table(df, f"{base}/t.csv", fmt="csv")
    tables.write_table(df, f"{base}/t.parquet")
    back = tables.read_table(spark, f"{base}/t.csv", schema="TransactionID long, TransactionAmt double, ProductCD string")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    assert tables.read_table(spark, f"{base}/t.parquet", columns=["ProductCD"]).columns == ["ProductCD"]


def test_profile_json_layout_and_required(spark):
    df = fixture(spark, SF001, "fx_ieee")
    prof = profiling.dataset_profile(df, "isFraud", "x", "y")
    base = tempfile.mkdtemp(prefix="rl-prof-", dir="/tmp")
    tables.write_profile(prof, f"{base}/p")
    row = spark.read.json(f"{base}/p").first()
    assert row["rows"] == df.count() and row["columns"] == len(df.columns)
    lay = tables.dataset_layout("/data/out", "ieee_cis")
    assert lay["graph"] == "/data/out/ieee_cis/graph"
    with pytest.raises(ValueError):
        tables.require_columns(df, ["TransactionID", "nope"])


def test_split_target(spark):
    df = fixture(spark, SF001, "fx_ieee")
    x, y = sampling.split_target(df)
    assert "isFraud" not in x.columns and "TransactionID" not in x.columns
    assert dict(y.dtypes)["isFraud"] == "tinyint"


def test_model_save_load_and_forest(spark):
    df = fixture(spark, SF001, "fx_ieee").select("TransactionAmt", "TransactionDT", "isFraud").fillna(0)
    m = models.fit_fraud_model(df, ["TransactionAmt", "TransactionDT"], rounds=3, depth=2)
    path = tempfile.mkdtemp(prefix="rl-model-", dir="/tmp") + "/gbt"
    models.save_model(m, path)
    a = models.predict_probability(m, df).select("fraud_probability")
    b = models.predict_probability(models.load_model(path), df).select("fraud_probability")
    assert a.exceptAll(b).count() == 0
    assert models.class_weight(df).first()[0] > 1.0
    forest = models.fit_isolation_forest(df, ["TransactionAmt", "TransactionDT"], trees=10)
    s = forest.anomaly_score(df).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert s[0] is not None and s[0] <= s[1]
    # about 2% of training rows lie below the offset (decision < 0 -> anomaly_score > 1)
    frac = forest.anomaly_score(df).agg(F.avg((F.col("anomaly_score") > 1).cast("double"))).first()[0]
    assert 0.0 < frac < 0.06


def test_workflow_outputs(spark):
    from riskloom.plans import prepare
    root = tempfile.mkdtemp(prefix="rl-out-", dir="/tmp")
    p = prepare.prepare_transactions(fixture(spark, SF001, "fx_ieee"), fixture(spark, SF001, "fx_identity"),
                                     prepare.IEEE_SAMPLE, sample_size=100)
    lay = prepare.write_transaction_outputs(p, root, prepare.IEEE_SAMPLE["name"])
    prof = spark.read.json(f"{lay['profiles']}/ieee_cis_dev_sample_cleaned_profile").first()
    assert prof["rows"] == 100 and prof["sample_size"] == 100 and prof["dropped_columns"] == ["dist1"]
    assert spark.read.parquet(f"{lay['processed']}/ieee_cis_dev_sample_processed").count() == 100
    g = prepare.prepare_payments(fixture(spark, SF001, "fx_pay_keyed"), sample_size=0)
    lay = prepare.write_payment_outputs(g, root)
    gp = spark.read.json(f"{lay['profiles']}/paysim_graph_profile").first()
    assert gp["edge_count"] == spark.read.parquet(f"{lay['graph']}/paysim_graph_edges").count()


def test_bucketed_edges_are_counted_without_exchange(spark, tmp_path):
    from pyspark.sql import functions as F

    from riskloom.operators import history
    edges = spark.range(400).select("id", F.lit(None).cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("id") % 37).alias("user"),
                                    F.concat(F.lit("d"), F.col("id") % 11).alias("device"), F.lit(1.0).alias("amount"))
    names = tables.write_bucketed_edges(edges, str(tmp_path), "edges_plan_test", buckets=8)
    users, devices = (tables.read_edges(spark, n) for n in names)
    for df in (history.user_degree(users), history.device_degree(devices), users.join(history.user_degree(users), "user")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
    snap = history.degree_snapshot(users.select("id", "user", "device"), users, by_device=devices)
    plain = history.degree_snapshot(edges.select("id", "user", "device"), edges)
    assert sorted(map(tuple, snap.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert tables.read_edges(spark, str(tmp_path / names[0])).count() == 400
    for n in names:
        spark.sql(f"DROP TABLE {n}")
