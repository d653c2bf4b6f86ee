"""Reports from the daily rollup equal those over all predictions, and read no more than they need."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports, rollup
from riskloom.plans import q_report
from riskloom.streaming import stream as ST
from riskloom.streaming.state import Increments

ASOF = "2024-01-08 09:30:00"
SCHEMA = "transaction_id string, created_at timestamp, amount double, card1 long, device string, fraud_probability double, risk_score double, risk_level string, addr1 long, reasons_json string"


def _preds(spark, n=60, days=12):
    rows = [(f"T{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % days, minutes=i), 1.0, i, "mobile" if i % 9 == 0 else "desktop", 0.5, i * 1.37 % 100,
             ("High", "medium", "LOW", "high")[i % 4], 0, '["a"]') for i in range(n)]
    rows += [("T900", None, 1.0, 1, None, 0.5, 10.0, "High", 0, "[]"), ("T901", dt.datetime(2024, 1, 2), 1.0, 1, "mobile", 0.5, None, None, 0, "[]")]
    return spark.createDataFrame(rows, SCHEMA)


def _stored(spark, preds):
    folder = tempfile.mkdtemp(prefix="rl-roll-", dir="/tmp")
    table = Increments(f"{folder}/rollup", rollup.SCHEMA, ["day", "level"], rollup.MERGE, buckets=1)
    for batch in range(3):
        part = preds.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == batch)
        part.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(f"{folder}/predictions")
        table.write(rollup.daily_rollup(part), batch)
    return spark.read.parquet(f"{folder}/predictions"), table.before(spark, 3)


@pytest.fixture(scope="module")
def both(spark):
    preds = _preds(spark).checkpoint()
    return preds, *_stored(spark, preds)


def _rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_figures_equal_those_over_all_rows(both):
    preds, _, rolled = both
    assert _rows(rollup.dashboard_kpis(rolled, ASOF)) == _rows(reports.dashboard_kpis(preds, ASOF))
    assert _rows(rollup.risk_over_time(rolled, ASOF)) == _rows(reports.risk_over_time(preds, ASOF))
    assert _rows(rollup.risk_breakdown(rolled)) == _rows(reports.risk_breakdown(preds))
    assert _rows(rollup.analytics_snapshot(rolled)) == _rows(reports.analytics_snapshot(preds))
    assert _rows(rollup.daily_risk_counts(rolled)) == _rows(reports.daily_risk_counts(preds))
    assert _rows(rollup.latest_timestamp(rolled)) == _rows(reports.latest_timestamp(preds))


def test_figures_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rolled = rollup.daily_rollup(empty)
    assert _rows(rollup.dashboard_kpis(rolled, ASOF)) == _rows(reports.dashboard_kpis(empty, ASOF))
    assert _rows(rollup.analytics_snapshot(rolled)) == _rows(reports.analytics_snapshot(empty))
    assert rollup.list_transactions(empty.withColumn("day", F.to_date("created_at")), rolled, 5).count() == 0


def test_figures_do_not_read_predictions(both):
    _, _, rolled = both
    for df in (rollup.dashboard_kpis(rolled, ASOF), rollup.risk_over_time(rolled, ASOF), rollup.analytics_snapshot(rolled)):
        assert df.inputFiles() and all("/rollup/" in f for f in df.inputFiles())


@pytest.mark.parametrize("limit,risk,device,days", [(5, None, None, 1), (6, None, None, 2), (7, "high", None, 3), (2, "Medium", "MOBILE", 8), (3, "all", "mobile", 8), (1000, None, None, 13)])
def test_listings_read_the_newest_days_that_fill_the_limit(both, limit, risk, device, days):
    preds, by_day, rolled = both
    found, read = rollup.newest(by_day, rolled, limit, risk, device)
    assert _rows(rollup.list_transactions(by_day, rolled, limit, risk, device)) == _rows(reports.list_transactions(preds, limit, risk, device))
    assert len(read) <= days and read == sorted((d for d in read if d), reverse=True) + [d for d in read if d is None]
    assert {r[0] for r in found.select("day").distinct().collect()} <= set(read)


def test_alerts_read_the_newest_days(both):
    preds, by_day, rolled = both
    assert _rows(rollup.alerts(by_day, rolled)) == _rows(reports.alerts(preds))
    assert len(rollup.newest(by_day, rolled, 3, "high")[1]) <= 2


def test_scoring_stream_keeps_the_rollup(spark):
    out = tempfile.mkdtemp(prefix="rl-srol-", dir="/tmp")
    for batch in range(2):
        rows = [(batch * 50 + i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i + batch), 20.0 * i, i % 9, "mobile", None) for i in range(20)]
        df = spark.createDataFrame(rows, "TransactionID long, ts timestamp, TransactionAmt double, card1 long, device string, addr1 int")
        for _ in range(1 + batch):                                   # the second batch is run twice
            ST.score_batch(df, batch, out, q_report.standin_probability, q_report.standin_anomaly)
    preds, rolled = ST.read_predictions(spark, out), ST.read_rollup(spark, out)
    assert ST.newest_batch(spark, out) == 1
    assert _rows(rollup.dashboard_kpis(rolled, ASOF)) == _rows(reports.dashboard_kpis(preds, ASOF))
    assert _rows(rollup.analytics_snapshot(rolled)) == _rows(reports.analytics_snapshot(preds))
