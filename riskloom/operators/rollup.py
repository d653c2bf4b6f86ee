"""Reports from a daily rollup of the predictions (R1-R4, R7, G5-G8, and the day ranges of I1, R5, R6).

One row per (day, level) with counts, score sums and the newest time. Such rows add up: a batch writes those of its own
predictions (``riskloom.streaming.state.Increments``), a report reads a few rows per day in place of all history. Day
bounds are UTC midnights, which is where all the reports cut. Listings use the counts to choose the days they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import reports
from riskloom.operators.reports import LEVELS

SCHEMA = "day date, level string, n long, score decimal(38,6), scored long, latest timestamp"
MERGE = {"n": "sum", "score": "sum", "scored": "sum", "latest": "max"}


def daily_rollup(preds: DataFrame, ts: str = "created_at") -> DataFrame:
    """The rollup rows of some predictions; those without a time or level have rows of their own."""
    return (preds.groupBy(F.to_date(F.col(ts)).alias("day"), F.lower("risk_level").alias("level"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("risk_score").cast("decimal(18,6)")).cast("decimal(38,6)").alias("score"),
                 F.count("risk_score").alias("scored"), F.max(F.col(ts).cast("timestamp")).alias("latest"))
            .withColumn("score", F.coalesce("score", F.lit(0).cast("decimal(38,6)"))))


def _n(where=None):
    return F.coalesce(F.sum(F.when(where, F.col("n")) if where is not None else F.col("n")), F.lit(0)).cast("long")


def dashboard_kpis(rollup: DataFrame, asof: str) -> DataFrame:
    """R1 + R2."""
    today = F.to_date(F.lit(asof).cast("timestamp"))
    agg = rollup.agg(_n().alias("total_scanned"), _n(F.col("day") >= today).alias("scanned_today"),
                     _n(F.col("day") == F.date_sub(today, 1)).alias("scanned_yesterday"),
                     _n(F.col("level") == "high").alias("fraud_detected"), _n(F.col("level") == "medium").alias("under_review"))
    return agg.select("total_scanned", "scanned_today", "scanned_yesterday", F.greatest(F.col("scanned_today") - F.col("scanned_yesterday"), F.lit(0)).alias("delta_scanned"),
                      "fraud_detected", "under_review", reports._rate(F.col("fraud_detected"), F.col("total_scanned")).alias("detection_rate"))


def daily_risk_counts(rollup: DataFrame) -> DataFrame:
    """G7."""
    return rollup.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*(_n(F.col("level") == lv).alias(lv) for lv in LEVELS))


def risk_over_time(rollup: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """The ``days`` days up to ``asof``'s, zero-filled; the calendar has ``days`` rows."""
    end = F.to_date(F.lit(asof).cast("timestamp"))
    calendar = rollup.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    daily = rollup.where(F.col("day").between(F.date_sub(end, days - 1), end)).groupBy("day").agg(*(_n(F.col("level") == lv).alias(lv) for lv in LEVELS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))                 # noqa: E731
    return daily.join(F.broadcast(calendar), "day", "right").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "E").alias("label"), zero("high").alias("high"), zero("medium").alias("med"), zero("low").alias("low"))


def risk_breakdown(rollup: DataFrame) -> DataFrame:
    """Counts per level and shares over a total floored at 1."""
    agg = rollup.agg(*(_n(F.col("level") == lv).alias(lv) for lv in LEVELS))
    total = F.greatest(F.col("high") + F.col("medium") + F.col("low"), F.lit(1))
    return agg.select("high", F.col("medium").alias("med"), "low", (F.col("high") / total).alias("high_share"),
                      (F.col("medium") / total).alias("med_share"), (F.col("low") / total).alias("low_share"))


def analytics_snapshot(rollup: DataFrame) -> DataFrame:
    """R7 (G6: its average risk)."""
    agg = rollup.agg(_n().alias("_n"), (F.sum("score").cast("double") / F.nullif(F.sum("scored"), F.lit(0))).alias("_avg"),
                     _n(F.col("level") == "high").alias("_high"), _n(F.col("level") == "medium").alias("_med"))
    rate = reports._rate(F.col("_high"), F.col("_n"))
    return agg.select(R.py_round(F.coalesce(F.col("_avg"), F.lit(0.0)), 2).alias("avg_risk_score"),
                      F.greatest(F.lit(1.0), R.py_round((F.col("_high") + F.col("_med")) / 2, 1)).alias("avg_cluster_size"),
                      R.py_round(F.greatest(F.lit(0.5), F.lit(100.0) - rate) / 20, 1).alias("false_positive_proxy"), rate.alias("detection_rate"))


def latest_timestamp(rollup: DataFrame) -> DataFrame:
    """G8."""
    return rollup.agg(F.max("latest").alias("latest_created_at"))


def days_back(rollup: DataFrame, level: str | None = None) -> list[tuple]:
    """(day, rows) from the newest day backward, those without a day last (one row per day comes to the driver)."""
    rows = rollup.where(F.col("level") == level.lower()) if level else rollup
    found = {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.sum("n").alias("n")).collect()}
    return sorted(((d, n) for d, n in found.items() if d is not None), reverse=True) + [(d, n) for d, n in found.items() if d is None]


def of_days(preds: DataFrame, days: list) -> DataFrame:
    """The predictions of some day partitions (column ``day``)."""
    some = [d for d in days if d is not None]
    cond = F.col("day").isin(some) if some else F.lit(False)
    return preds.where(cond | F.col("day").isNull() if None in days else cond)


def newest(preds: DataFrame, rollup: DataFrame, limit: int, risk: str | None = None, device: str | None = None) -> tuple[DataFrame, list]:
    """The predictions (partitioned by ``day``) that hold the newest ``limit`` rows under the filters of I1, and the days read: as many
    as the rollup says hold ``limit`` rows of the level. Devices are not in the rollup: with that filter the matches are
    counted, and the days doubled until the limit is filled or none are left."""
    level = risk if risk and risk.lower() != "all" else None
    back = days_back(rollup, level)
    take, have = 0, 0
    while take < len(back) and have < limit:
        have += back[take][1]
        take += 1
    found = lambda: reports.filter_transactions(of_days(preds, [d for d, _ in back[:take]]), risk, device)      # noqa: E731
    if device and device.lower() != "all":
        while take < len(back) and found().limit(limit).count() < limit:
            take = min(len(back), max(1, 2 * take))
    return found(), [d for d, _ in back[:take]]


def list_transactions(preds: DataFrame, rollup: DataFrame, limit: int = 50, risk: str | None = None, device: str | None = None) -> DataFrame:
    """As ``reports.list_transactions``, reading only the newest days that fill the limit."""
    return reports.list_transactions(newest(preds, rollup, limit, risk, device)[0], limit)


def alerts(preds: DataFrame, rollup: DataFrame) -> DataFrame:
    """R6, reading only the days that hold the newest three high and two medium rows."""
    return reports.alerts(newest(preds, rollup, 3, "high")[0].unionByName(newest(preds, rollup, 2, "medium")[0]))
