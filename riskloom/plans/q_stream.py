"""Query keys for the streaming operators (T2 with an oracle; T1 is checked against batch scoring in
tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import reports
from riskloom.plans import q_report
from riskloom.plans.registry import query
from riskloom.session import scratch_path
from riskloom.sources.fixtures import FIXTURE_SQL, with_views
from riskloom.sources.tables import table
from riskloom.streaming import stream as ST

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


ARRIVALS, ARRIVAL_FILES = 3, 8


def event_stream(spark, sf_dir, again: bool = False):
    """The whole events table as a file stream of ``ARRIVALS`` micro-batches in time order: its rows are dealt by time into arrivals of
    ``ARRIVAL_FILES`` files that are written one after the other. ``again``: each arrival also delivers the events of the one
    before whose number ends in 0 a second time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(seconds.cast("double").alias("t")).approxQuantile("t", [i / ARRIVALS for i in range(1, ARRIVALS)], 0.01)
    folder = scratch_path(spark, "arrivals")
    arrival = sum((F.coalesce((seconds >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    for k in range(ARRIVALS):
        part = events.where(arrival == k)
        if again and k:
            part = part.unionByName(events.where((arrival == k - 1) & (F.col("event_id") % 10 == 0)))
        part.repartition(ARRIVAL_FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", ARRIVAL_FILES).parquet(folder)


def pred_stream(spark, sf_dir, again: bool = False):
    """fx_pred over the arriving events."""
    events = event_stream(spark, sf_dir, again)
    return spark.sql(FIXTURE_SQL["fx_pred"], events=events)


@query("stream_daily_risk", with_views("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, lower(risk_level) AS level, count(*) AS n FROM fx_pred GROUP BY 1, 2""",
                                       "fx_pred"))
def q_stream_daily_risk(spark, sf_dir):
    return ST.run_daily_risk(spark, pred_stream(spark, sf_dir))


@query("stream_daily_redelivered", with_views("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, lower(risk_level) AS level, count(*) AS n FROM fx_pred GROUP BY 1, 2""",
                                              "fx_pred"))
def q_stream_daily_redelivered(spark, sf_dir):
    """T2 with rows that arrive again in the next batch."""
    return ST.run_daily_risk(spark, pred_stream(spark, sf_dir, again=True), key="transaction_id")


def txn_stream(spark, sf_dir):
    """fx_txn over the arriving events (parquet timestamps cast to UTC)."""
    events = event_stream(spark, sf_dir)
    txn = spark.sql(FIXTURE_SQL["fx_txn"], events=events)
    return txn.withColumn("ts", txn["ts"].cast("timestamp"))


@query("stream_score", q_report._scored_sql(
    "SELECT TransactionID AS transaction_id, risk_score, risk_level, reasons_json FROM final"))
def q_stream_score(spark, sf_dir):
    """T1 end to end: arriving transactions scored in micro-batches against the stored edge history
    (stand-in model columns), predictions read back from the sink."""
    out = scratch_path(spark, "stream-score")
    q = ST.start_scoring(txn_stream(spark, sf_dir), out, q_report.standin_probability, q_report.standin_anomaly)
    q.awaitTermination()
    return ST.read_predictions(spark, out).select(F.col("source_id").alias("transaction_id"), "risk_score", "risk_level",
                                                  "reasons_json")


STORED_CTE = """stored AS (SELECT TransactionID, 'TXN-' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || upper(substr(md5(CAST(TransactionID AS VARCHAR)), 1, 4)) AS id,
    CAST(coalesce(TransactionAmt, 0) AS DOUBLE) AS amount, coalesce(card1, 0) AS card1, coalesce(device, 'unknown') AS device,
    coalesce(addr1, 0) AS addr1, p, risk_score, risk_level, reasons_json, ts FROM final)"""


@query("stream_listing", q_report._scored_sql("""
SELECT id, amount, card1, device, addr1, replace(reasons_json, '", "', '","') AS reasons, risk_score, risk_level AS risk,
       strftime(ts, '%Y-%m-%d %H:%M') AS date
FROM (SELECT * FROM stored ORDER BY ts DESC, id DESC LIMIT 20)""", STORED_CTE))
def q_stream_listing(spark, sf_dir):
    """T1 -> A6 -> I1: what the stream stored is listed, newest first."""
    out = scratch_path(spark, "stream-listing")
    ST.start_scoring(txn_stream(spark, sf_dir), out, q_report.standin_probability, q_report.standin_anomaly).awaitTermination()
    listed = reports.list_transactions(ST.read_predictions(spark, out), 20)
    return listed.select("id", "amount", "card1", "device", "addr1", F.to_json("reasons").alias("reasons"), "risk_score", "risk", "date")
