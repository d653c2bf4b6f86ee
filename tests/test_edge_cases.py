"""Edge cases and limits: long paths, repeated values and keys, NaN, labels, trees, late batches."""

import datetime
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import cleaning, graph, metrics, models, profiling, reports, sampling, selection
from riskloom.plans import prepare
from riskloom.sources.fixtures import fixture
from riskloom.streaming import stream as ST

from conftest import SF001


def test_components_of_a_long_path(spark):
    names = [f"n{i:04d}" for i in range(700)]
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame(list(zip(names[:-1], names[1:])), "user string, device string")
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {"n0000"}


def test_order_statistics_of_two_heavily_repeated_values(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(5.0).alias("v"), F.col("id").cast("double").alias("w"))
    got = selection.exact_order_stats(df, {"v": [1, 20_000, 20_001, 40_000], "w": [1, 777]}, max_bracket=100)
    assert got["v"] == {1: 1.0, 20_000: 1.0, 20_001: 5.0, 40_000: 5.0} and got["w"] == {1: 0.0, 777: 776.0}


def test_codes_above_any_inline_size(spark):
    df = spark.range(30_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    codes = cleaning.fit_code_table(df, ["c"])
    more = df.unionByName(spark.createDataFrame([("unseen",), (None,)], "c string"))
    out = cleaning.apply_codes(more, codes, ["c"])
    want = {v: float(i) for i, v in enumerate(sorted(f"v{i}" for i in range(30_000)))}
    assert sorted(r["c"] for r in out.collect()) == sorted([-1.0, -1.0, *want.values()])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (3.0,)], "v double")
    assert profiling.null_ratios_row(df) == {"v": 0.5}
    assert profiling.null_ratio(df).first()["missing_ratio"] == 0.5
    assert selection.exact_medians(df, ["v"]) == {"v": 2.0}
    assert sorted(r["v"] for r in cleaning.impute_median(df).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_device_labels_keep_title_case_after_digits_and_signs(spark):
    names = ["sm-g960u", "ios device", "windows_10 pc", "été-x1y"]
    edges = spark.createDataFrame([("user_1", f"device_{n}") for n in names], "user string, device string")
    none = spark.createDataFrame([], "card1 long, device string, risk_level string")
    got = {r["label"] for r in graph.graph_nodes(edges, none).where("type = 'device'").collect()}
    assert got == {f"device_{n}".replace("device_", "Device ").title() for n in names}


def test_sample_counts_rows_that_repeat_a_key(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(300)] + [(None, -1)], "k long, v long")
    for n in (10, 100, 299):
        assert sampling.sample_n(df, n, key="k").count() == n
    same = spark.range(200).select(F.lit(1).alias("k"))
    assert selection.hash_cutoff(same, "k", 1, {None: 50}).where("_selected").count() == 50
    assert selection.hash_cutoff(same, "k", 1, {None: 50}, final_rows=100).where("_selected").count() == 50
    with pytest.raises(ValueError):
        sampling.class_targets(spark.range(2000).withColumnRenamed("id", "y"), "y", 0.2)


def test_payments_need_their_key(spark):
    with pytest.raises(ValueError):
        prepare.prepare_payments(fixture(spark, SF001, "fx_pay"))


@pytest.fixture(scope="module")
def forest(spark):
    df = spark.range(3000).select("id", F.rand(5).alias("a"), F.when(F.col("id") % 97 == 0, 50.0).otherwise(F.rand(6)).alias("b")).checkpoint()
    return df, models.fit_isolation_forest(df, ["a", "b"], trees=30)


def test_trees_draw_their_own_full_samples(spark, forest):
    df, model = forest
    roots = model.trees[model.trees["node"] == 0]
    assert len(roots) == 30 and set(roots["size"]) == {256}
    share = model.anomaly_score(df).where("anomaly_score > 1").count() / 3000
    assert abs(share - 0.02) < 0.003
    again = models.fit_isolation_forest(df.repartition(7), ["a", "b"], trees=30)
    pd.testing.assert_frame_equal(model.trees.sort_values(["tree", "node"]).reset_index(drop=True),
                                  again.trees.sort_values(["tree", "node"]).reset_index(drop=True))
    few = models.fit_isolation_forest(df.limit(40), ["a", "b"], trees=5)
    assert set(few.trees.loc[few.trees["node"] == 0, "size"]) == {40}


def test_forest_is_saved_and_loaded(spark, forest, tmp_path):
    df, model = forest
    model.save(spark, str(tmp_path / "forest"))
    loaded = models.IsolationForestModel.load(spark, str(tmp_path / "forest"))
    a = {r["id"]: r["anomaly_score"] for r in model.anomaly_score(df).collect()}
    assert a == {r["id"]: r["anomaly_score"] for r in loaded.anomaly_score(df).collect()}


def test_metrics_with_crowded_scores(spark):
    r = random.Random(1)
    rows = [(r.random() / 1000 if r.random() < 0.99 else r.random(), int(r.random() < 0.1)) for _ in range(4000)] + [(None, 0)]
    df = spark.createDataFrame(rows, "fraud_probability double, isFraud int")
    one, many = metrics.roc_auc(df).first()[0], None
    before = metrics.BUCKET_SCORES
    metrics.BUCKET_SCORES = 50
    try:
        bucketed = metrics._by_score(df, "isFraud", "fraud_probability", metrics.SCORE_BUCKETS)
        sizes = [x["count"] for x in bucketed.groupBy("_bucket").count().collect()]
        many = metrics.roc_auc(df).first()[0]
    finally:
        metrics.BUCKET_SCORES = before
    assert one == many and len(sizes) > 40 and max(sizes) <= 150


def test_late_batches_are_shifted_by_whole_microseconds(spark):
    last = datetime.datetime(2024, 1, 1, 0, 0, 10)
    for micros in (1, 249, 1_000_001, 199_999):
        batch = spark.createDataFrame([(last - datetime.timedelta(microseconds=micros),)], "ts timestamp")
        assert ST._shift_after(last, batch, "ts").first()["ts"] == last + datetime.timedelta(microseconds=1)


def test_stored_predictions_feed_listings_and_alerts(spark):
    rows = [(i, datetime.datetime(2024, 1, i + 1, 9), "High" if i % 2 else "Medium", '["x", "y"]', 5 + i) for i in range(6)]
    preds = spark.createDataFrame(rows, "transaction_id long, created_at timestamp, risk_level string, reasons_json string, addr1 long") \
        .withColumns({"amount": F.lit(1.0), "card1": F.lit(2), "device": F.lit("d"), "fraud_probability": F.lit(0.5), "risk_score": F.lit(71.0)})
    top = reports.list_transactions(preds, 2).collect()
    assert [(t["id"], t["addr1"], t["reasons"]) for t in top] == [(5, 10, ["x", "y"]), (4, 9, ["x", "y"])]
    assert [a["sub"] for a in reports.alerts(preds).collect()][-1] == "4 has 2 triggered rules"


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(datetime.datetime(2024, 1, 1), "High")], "created_at timestamp, risk_level string").write.parquet(str(tmp_path / "p"))
    preds = spark.read.parquet(str(tmp_path / "p"))
    for df in (reports.count_between(preds, "2024-01-01", "2024-01-02"), reports.risk_breakdown(preds, "2024-01-01", None)):
        assert "GreaterThanOrEqual(created_at" in df._jdf.queryExecution().executedPlan().toString()


def test_functions_reach_workers_from_a_foreign_folder(tmp_path):
    """Executors get the package's functions by value: started elsewhere, workers can't import it."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from riskloom.session import build_session
from riskloom.operators import models
from pyspark.sql import functions as F
spark = build_session("local[2]", 2)
df = spark.range(300).select(F.rand(1).alias("a"))
print(models.fit_isolation_forest(df, ["a"], trees=3).anomaly_score(df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"RISKLOOM_DRIVER_MEMORY": "1g"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("300"), done.stderr[-1500:]


def test_sampling_where_one_key_repeats_beyond_any_task(spark):
    """The cut falls among many rows of one key: exactly the wanted number is taken, by class."""
    from riskloom.operators import selection
    rows = [(7, i % 2, i) for i in range(400)] + [(i, i % 2, i) for i in range(1000, 1060)] + [(None, 0, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, c int, n int").repartition(5)
    for targets, cls in (({0: 60, 1: 130}, "c"), ({0: 200, 1: 3}, "c"), ({None: 250}, None), ({None: 500}, None)):
        got = selection.hash_cutoff(df, "k", 42, targets, cls, final_rows=20)
        assert got.count() == len(rows) and got.select("n", "k", "c").distinct().count() == len(set(rows))
        taken = got.where("_selected")
        counts = {r[0]: r[1] for r in taken.groupBy(cls).count().collect()} if cls else {None: taken.count()}
        assert counts == targets


def test_time_buckets_in_two_levels(spark, monkeypatch):
    from riskloom.operators import history
    monkeypatch.setattr(history, "COARSE", 4)
    df = spark.range(6000).selectExpr("id", "timestamp_micros(id * id) AS ts")
    got = history.time_buckets(df, target_rows=200)
    sizes = [r["count"] for r in got.groupBy("_bucket").count().collect()]
    assert len(sizes) >= 24 and max(sizes) <= 600
    edges = got.groupBy("_bucket").agg({"id": "min", "ts": "max"}).orderBy("_bucket").collect()
    assert [r["min(id)"] for r in edges] == sorted(r["min(id)"] for r in edges)
