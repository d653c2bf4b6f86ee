"""Reports over the predictions table.

The reference runs one SQL query per figure; here one conditional aggregate serves the KPIs,
breakdown and snapshot, one daily aggregate the weekly series, and top-k plans the listings.
``asof`` is passed in (never ``current_timestamp`` inside a query) so reports are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rules as R

LEVELS = ("high", "medium", "low")


def _lv(level: str = "risk_level") -> Column:
    return F.lower(F.col(level))


def _ts(value) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else F.lit(value)


def between(ts: Column, start=None, end=None) -> Column:
    """Half-open ``[start, end)``; either end may be open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= _ts(start))
    if end is not None:
        cond = cond & (ts < _ts(end))
    return cond


def count_between(preds: DataFrame, start=None, end=None, ts: str = "created_at") -> DataFrame:
    """G4. The range is a filter, so it reaches the scan."""
    return preds.where(between(F.col(ts), start, end)).agg(F.count(F.lit(1)).alias("count"))


def count_by_level(preds: DataFrame, level: str, start=None, end=None, ts: str = "created_at") -> DataFrame:
    """Case-insensitive level, optional range; both are filters."""
    return preds.where(between(F.col(ts), start, end) & (_lv() == level.lower())).agg(F.count(F.lit(1)).alias("count"))


def average_risk(preds: DataFrame) -> DataFrame:
    """Mean score to 2 places, 0 when empty."""
    return preds.agg(R.py_round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 2).alias("avg_risk_score"))


def latest_timestamp(preds: DataFrame, ts: str = "created_at") -> DataFrame:
    """Newest time, null when empty."""
    return preds.agg(F.max(ts).alias("latest_created_at"))


def _rate(high: Column, total: Column) -> Column:
    """R2: high share in percent, 1 place, 0 when empty."""
    return F.when(total == 0, F.lit(0.0)).otherwise(R.py_round(high / total * 100, 1))


def dashboard_kpis(preds: DataFrame, asof: str, ts: str = "created_at") -> DataFrame:
    """R1 + R2 from one aggregate: totals, today / yesterday scans (UTC days), delta floored at 0,
    high and medium counts, detection rate."""
    today = F.date_trunc("day", _ts(asof))
    yesterday = today - F.expr("INTERVAL 1 DAY")
    t = F.col(ts)
    agg = preds.agg(F.count(F.lit(1)).alias("total_scanned"),
                    F.count_if(t >= today).alias("scanned_today"),
                    F.count_if((t >= yesterday) & (t < today)).alias("scanned_yesterday"),
                    F.count_if(_lv() == "high").alias("fraud_detected"),
                    F.count_if(_lv() == "medium").alias("under_review"))
    return agg.select("total_scanned", "scanned_today", "scanned_yesterday",
                      F.greatest(F.col("scanned_today") - F.col("scanned_yesterday"), F.lit(0)).alias("delta_scanned"),
                      "fraud_detected", "under_review",
                      _rate(F.col("fraud_detected"), F.col("total_scanned")).alias("detection_rate"))


def risk_breakdown(preds: DataFrame, start=None, end=None, ts: str = "created_at") -> DataFrame:
    """Counts per level and shares over a total floored at 1."""
    agg = preds.where(between(F.col(ts), start, end)).agg(*[F.count_if(_lv() == lv).alias(lv) for lv in LEVELS])
    total = F.greatest(F.col("high") + F.col("medium") + F.col("low"), F.lit(1))
    return agg.select(F.col("high"), F.col("medium").alias("med"), F.col("low"),
                      (F.col("high") / total).alias("high_share"), (F.col("medium") / total).alias("med_share"),
                      (F.col("low") / total).alias("low_share"))


def daily_risk_counts(preds: DataFrame, start=None, end=None, ts: str = "created_at") -> DataFrame:
    """Per UTC day, conditional counts per level. The range filter reaches the scan."""
    return (preds.where(between(F.col(ts), start, end))
            .groupBy(F.date_format(F.col(ts), "yyyy-MM-dd").alias("day"))
            .agg(*[F.count_if(_lv() == lv).alias(lv) for lv in LEVELS]))


def risk_over_time(preds: DataFrame, asof: str, days: int = 7, ts: str = "created_at") -> DataFrame:
    """The ``days`` UTC days ending on ``asof``'s day, weekday label, zero-filled (N18). The
    calendar has ``days`` rows (a fixed bound), so it is broadcast."""
    spark = preds.sparkSession
    end_day = F.to_date(_ts(asof))
    cal = spark.range(1).select(F.explode(F.sequence(F.date_sub(end_day, days - 1), end_day)).alias("day"))
    lo = F.date_sub(end_day, days - 1).cast("timestamp")
    hi = F.date_add(end_day, 1).cast("timestamp")
    daily = (preds.where((F.col(ts) >= lo) & (F.col(ts) < hi))
             .groupBy(F.to_date(F.col(ts)).alias("day"))
             .agg(*[F.count_if(_lv() == lv).alias(lv) for lv in LEVELS]))
    return (daily.join(F.broadcast(cal), "day", "right")
            .select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "E").alias("label"),
                    F.coalesce(F.col("high"), F.lit(0)).alias("high"),
                    F.coalesce(F.col("medium"), F.lit(0)).alias("med"),
                    F.coalesce(F.col("low"), F.lit(0)).alias("low")))


def filter_transactions(preds: DataFrame, risk: str | None = None, device: str | None = None) -> DataFrame:
    """Case-insensitive filters; ``all`` or empty means none."""
    out = preds
    if risk and risk.lower() != "all":
        out = out.where(_lv() == risk.lower())
    if device and device.lower() != "all":
        out = out.where(F.lower(F.col("device")) == device.lower())
    return out


def format_times(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """``HH:mm`` and ``yyyy-MM-dd HH:mm`` (UTC session)."""
    return df.withColumn("time", F.date_format(F.col(ts), "HH:mm")) \
             .withColumn("date", F.date_format(F.col(ts), "yyyy-MM-dd HH:mm"))


def _reasons(df: DataFrame) -> Column:
    """The reasons as a list: the column itself, or decoded from the stored JSON text; none: empty."""
    if "reasons" in df.columns:
        found = F.col("reasons")
    elif "reasons_json" in df.columns:
        found = F.from_json("reasons_json", "array<string>")
    else:
        found = F.lit(None)
    return F.coalesce(found.cast("array<string>"), F.array().cast("array<string>"))


def _listing(df: DataFrame, id_col: str) -> DataFrame:
    addr1 = F.col("addr1").cast("long") if "addr1" in df.columns else F.lit(0).cast("long")
    return df.select(F.col(id_col).alias("id"), "amount", "card1", "device", F.coalesce(addr1, F.lit(0)).alias("addr1"),
                     _reasons(df).alias("reasons"), "fraud_probability", "risk_score",
                     F.col("risk_level").alias("risk"), R.status_from_level(F.col("risk_level")).alias("status"),
                     "created_at", "time", "date")


def list_transactions(preds: DataFrame, limit: int = 50, risk: str | None = None, device: str | None = None,
                      id_col: str = "transaction_id", ts: str = "created_at") -> DataFrame:
    """I1 (+ R8, D23): filtered, newest first, ``limit`` rows (a top-k: TakeOrderedAndProject)."""
    top = filter_transactions(preds, risk, device).orderBy(F.desc(ts), F.desc(id_col)).limit(limit)
    return _listing(format_times(top, ts), id_col)


def search_transactions(preds: DataFrame, text: str, id_col: str = "transaction_id") -> DataFrame:
    """Case-insensitive substring on id, device or card1 text; blank means every row."""
    if not text or not text.strip():
        return preds
    q = text.lower()
    return preds.where(F.lower(F.col(id_col).cast("string")).contains(q)
                       | F.lower(F.coalesce(F.col("device"), F.lit(""))).contains(q)
                       | F.coalesce(F.col("card1").cast("string"), F.lit("")).contains(q))


def alerts(preds: DataFrame, reason_count: Column | None = None, id_col: str = "transaction_id",
           ts: str = "created_at") -> DataFrame:
    """Newest 3 high and newest 2 medium, high first, first 4 kept. Two bounded top-k plans. The
    reasons are counted from the list or from the stored JSON text."""
    n_reasons = reason_count if reason_count is not None else F.size(_reasons(preds))
    high = (preds.where(_lv() == "high").orderBy(F.desc(ts), F.desc(id_col)).limit(3)
            .select(F.lit(0).alias("_g"), F.col(ts).alias("_t"), F.col(id_col).alias("_id"),
                    F.lit("High-risk transaction detected").alias("title"),
                    F.concat(F.col(id_col).cast("string"), F.lit(" scored "),
                             F.bround(F.col("risk_score"), 0).cast("long").cast("string"),
                             F.lit(" on "), F.coalesce(F.col("device"), F.lit("None"))).alias("sub"),
                    F.lit(True).alias("urgent")))
    med = (preds.where(_lv() == "medium").orderBy(F.desc(ts), F.desc(id_col)).limit(2)
           .select(F.lit(1).alias("_g"), F.col(ts).alias("_t"), F.col(id_col).alias("_id"),
                   F.lit("Manual review suggested").alias("title"),
                   F.concat(F.col(id_col).cast("string"), F.lit(" has "), n_reasons.cast("string"),
                            F.lit(" triggered rules")).alias("sub"),
                   F.lit(False).alias("urgent")))
    # The titles and phrases of the alerts above
    both = high.unionByName(med).orderBy("_g", F.desc("_t"), F.desc("_id")).limit(4)
    return both.select("title", "sub", "urgent")


def analytics_snapshot(preds: DataFrame) -> DataFrame:
    """R7 from one aggregate: average risk, cluster proxy, false-positive proxy, detection rate."""
    agg = preds.agg(F.count(F.lit(1)).alias("_n"), F.avg("risk_score").alias("_avg"),
                    F.count_if(_lv() == "high").alias("_high"), F.count_if(_lv() == "medium").alias("_med"))
    rate = _rate(F.col("_high"), F.col("_n"))
    return agg.select(
        R.py_round(F.coalesce(F.col("_avg"), F.lit(0.0)), 2).alias("avg_risk_score"),
        F.greatest(F.lit(1.0), R.py_round((F.col("_high") + F.col("_med")) / 2, 1)).alias("avg_cluster_size"),
        R.py_round(F.greatest(F.lit(0.5), F.lit(100.0) - rate) / 20, 1).alias("false_positive_proxy"),
        rate.alias("detection_rate"))


def prediction_rows(scored: DataFrame, id_col: str = "transaction_id", ts: str = "created_at",
                    user_id=None, keep: tuple = ()) -> DataFrame:
    """A6 + D23: rows as stored: ids ``TXN-<epoch ms>-<4 hex>`` (the hex derives from the row's key,
    where the reference draws it at random), null or 0 -> 0 for numbers, device default, status,
    reasons as JSON text. ``keep``: further columns."""
    hex4 = F.upper(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4))
    reasons = F.col("reasons_json") if "reasons_json" in scored.columns else R.reasons_json(F.col("reasons"))
    return scored.select(
        F.concat(F.lit("TXN-"), F.unix_millis(F.col(ts).cast("timestamp")).cast("string"), F.lit("-"), hex4)
         .alias("transaction_id"),
        F.lit(user_id).cast("long").alias("user_id"),
        F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.col("card1").cast("long"), F.lit(0)).alias("card1"),
        F.coalesce(F.col("device"), F.lit("unknown")).alias("device"),
        (F.coalesce(F.col("addr1").cast("long"), F.lit(0)) if "addr1" in scored.columns else F.lit(0).cast("long"))
         .alias("addr1"),
        F.coalesce(F.col("fraud_probability").cast("double"), F.lit(0.0)).alias("fraud_probability"),
        F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)).alias("risk_score"),
        F.coalesce(F.col("risk_level"), F.lit("Low")).alias("risk_level"),
        R.status_from_level(F.coalesce(F.col("risk_level"), F.lit("Low"))).alias("status"),
        reasons.alias("reasons_json"),
        F.col(ts).alias("created_at"), *keep)
