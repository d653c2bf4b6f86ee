"""Metrics against direct formulas (ties, one class) and report edge cases."""

import random

from riskloom.operators import metrics, reports
from riskloom.sources.fixtures import ASOF


def _auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap(pairs):
    P = sum(y for y, _ in pairs)
    ap = 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        at = [y for y, t in pairs if t == s]
        above = [y for y, t in pairs if t >= s]
        ap += sum(at) / P * (sum(above) / len(above))
    return ap


def test_auc_ap_with_ties(spark):
    rnd = random.Random(5)
    pairs = [(rnd.random() < 0.3 and 1 or 0, rnd.randint(0, 20) / 20) for _ in range(400)]
    df = spark.createDataFrame(pairs, "isFraud int, fraud_probability double")
    assert abs(metrics.roc_auc(df).first()[0] - _auc(pairs)) < 1e-12
    assert abs(metrics.average_precision(df).first()[0] - _ap(pairs)) < 1e-12


def test_report_single_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "isFraud int, fraud_probability double")
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["support"] == 0
    assert rep["accuracy"]["f1_score"] == 0.5


def test_reports_empty_and_mixed_case(spark):
    schema = ("transaction_id long, created_at timestamp, amount double, card1 long, device string, "
              "fraud_probability double, risk_score double, risk_level string")
    empty = spark.createDataFrame([], schema)
    k = reports.dashboard_kpis(empty, ASOF).first()
    assert k["total_scanned"] == 0 and k["detection_rate"] == 0.0
    assert reports.average_risk(empty).first()[0] == 0.0
    series = reports.risk_over_time(empty, ASOF).collect()
    assert len(series) == 7 and all(r["high"] == 0 for r in series)
    import datetime as dt
    rows = [(1, dt.datetime(2024, 1, 30, 0, 0), 1.0, 1, "Mobile", 0.9, 80.0, "HIGH"),
            (2, dt.datetime(2024, 1, 29, 23, 59, 59), 1.0, 1, "mobile", 0.5, 50.0, "medium"),
            (3, dt.datetime(2024, 1, 29, 0, 0), 1.0, 2, "desktop", 0.1, 10.0, "Low")]
    p = spark.createDataFrame(rows, schema)
    k = reports.dashboard_kpis(p, ASOF).first()
    assert (k["scanned_today"], k["scanned_yesterday"], k["delta_scanned"]) == (1, 2, 0)
    assert k["fraud_detected"] == 1 and k["detection_rate"] == 33.3
    assert [r["id"] for r in reports.list_transactions(p, 50, risk="high", device="MOBILE").collect()] == [1]
    a = reports.alerts(p, reason_count=p["card1"]).collect()
    assert [x["urgent"] for x in a] == [True, False] and a[0]["sub"] == "1 scored 80 on Mobile"


def test_breakdown_ranges_and_snapshot(spark):
    import datetime as dt
    schema = ("transaction_id long, created_at timestamp, amount double, card1 long, device string, "
              "fraud_probability double, risk_score double, risk_level string")
    empty = spark.createDataFrame([], schema)
    b = reports.risk_breakdown(empty).first()
    assert (b["high"], b["med"], b["low"], b["high_share"]) == (0, 0, 0, 0.0)      # total floored at 1
    s = reports.analytics_snapshot(empty).first()
    assert (s["avg_risk_score"], s["avg_cluster_size"], s["false_positive_proxy"], s["detection_rate"]) == \
        (0.0, 1.0, 5.0, 0.0)
    rows = [(i, dt.datetime(2024, 1, 10) + dt.timedelta(hours=6 * i), 1.0, 1, "desktop", 0.5, 10.0 * i,
             ["High", "medium", "LOW"][i % 3]) for i in range(12)]
    p = spark.createDataFrame(rows, schema)
    assert reports.count_between(p).first()[0] == 12
    assert reports.count_between(p, start="2024-01-11 00:00:00").first()[0] == 8      # half-open, open end
    assert reports.count_between(p, end="2024-01-11 00:00:00").first()[0] == 4
    assert reports.count_by_level(p, "high", "2024-01-10 00:00:00", "2024-01-11 00:00:00").first()[0] == 2
    b = reports.risk_breakdown(p).first()
    assert (b["high"], b["med"], b["low"]) == (4, 4, 4) and abs(b["high_share"] - 1 / 3) < 1e-12
    s = reports.analytics_snapshot(p).first()
    assert s["avg_risk_score"] == round(sum(10.0 * i for i in range(12)) / 12, 2)
    assert s["avg_cluster_size"] == 4.0 and s["detection_rate"] == 33.3
    assert s["false_positive_proxy"] == round(max(0.5, 100 - 33.3) / 20, 1)
    days = {r["day"]: (r["high"], r["medium"], r["low"]) for r in reports.daily_risk_counts(p).collect()}
    assert days["2024-01-10"] == (2, 1, 1) and sum(sum(v) for v in days.values()) == 12


def test_metrics_are_written_with_the_model(spark, tmp_path):
    from riskloom.operators import metrics
    rows = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6), (0, 0.1), (None, 0.3)]
    df = spark.createDataFrame(rows, "isFraud int, fraud_probability double")
    metrics.write_metrics(df, str(tmp_path / "metrics"))
    got = spark.read.json(str(tmp_path / "metrics")).first()
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert got["roc_auc"] == metrics.roc_auc(df).first()[0] and got["pr_auc"] == metrics.average_precision(df).first()[0]
    assert got["classification_report"]["accuracy"] == report["accuracy"]["f1_score"]
    assert got["classification_report"]["1"]["recall"] == report["1"]["recall"] and got["classification_report"]["macro avg"]["f1-score"] == report["macro avg"]["f1_score"]
