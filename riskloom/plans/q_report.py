"""Query keys for the blended score (L2-L4, L5 with stand-in model columns), stored rows (A6) and
reports (G4-G8, I1, D21-D23, R1-R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.functions.rules import py_round_sql as PR
from riskloom.operators import reports, rollup
from riskloom.plans import score
from riskloom.plans.q_graph import EDGES_CTE_SQL, FIRSTS_CTE, HIST_CTE, _recursive
from riskloom.plans.q_score import RULE_POINTS_SQL, RULE_REASON_ITEMS_SQL
from riskloom.plans.registry import ORACLES, query
from riskloom.session import scratch_path
from riskloom.sources.fixtures import ASOF, fixture, with_views
from riskloom.sources.tables import materialised
from riskloom.streaming.state import Increments


# Stand-in model outputs (the fx_pred formulas), so the whole blend has an exact oracle.
def standin_probability(df):
    return df.withColumn("fraud_probability", (F.col("TransactionID") * 37 % 1000).cast("double") / 1000)


def standin_anomaly(df):
    return df.withColumn("anomaly_score", F.lit(0.4) + (F.col("TransactionID") % 13).cast("double") * 0.0625)


def scored_txn(spark, sf_dir):
    return score.score(fixture(spark, sf_dir, "fx_txn"), standin_probability, standin_anomaly)


CLUS_REACH = """reach(rid, rts, node) AS (
  SELECT id, ts, "user" FROM edges
  UNION
  SELECT r.rid, r.rts, CASE WHEN f."user" = r.node THEN f.device ELSE f."user" END
  FROM reach r JOIN firsts f ON (f."user" = r.node OR f.device = r.node)
  WHERE f.ts < r.rts OR (f.ts = r.rts AND f.id <= r.rid)),
clus AS (SELECT rid AS id, count(*) > 4 AS in_cluster FROM reach GROUP BY rid)"""

BLEND_SQL = ("0.5 * (p * 100) + 0.2 * rule_score + 0.15 * (a * 100) + 0.15 * graph_score"
             " + CASE WHEN in_cluster THEN 10 ELSE 0 END")

SCORED_CTE = f"""scored AS (SELECT t.*, {RULE_POINTS_SQL} AS rule_score,
    (CASE WHEN h.user_degree + 1 > 5 THEN 20 ELSE 0 END) + (CASE WHEN h.device_users_incl > 3 THEN 25 ELSE 0 END) AS graph_score,
    h.user_degree, h.device_users_incl, c.in_cluster,
    CAST((t.TransactionID * 37) % 1000 AS DOUBLE) / 1000 AS p, 0.4 + CAST(t.TransactionID % 13 AS DOUBLE) * 0.0625 AS a
  FROM fx_txn t JOIN hist h ON h.id = t.TransactionID JOIN clus c ON c.id = t.TransactionID),
blend AS (SELECT *, {PR(BLEND_SQL, 2)} AS risk_score FROM scored),
final AS (SELECT *, CASE WHEN risk_score < 30 THEN 'Low' WHEN risk_score < 70 THEN 'Medium' ELSE 'High' END AS risk_level,
    '[' || concat_ws(', ', {RULE_REASON_ITEMS_SQL},
        CASE WHEN user_degree + 1 > 5 THEN '"User has high transaction frequency"' END,
        CASE WHEN device_users_incl > 3 THEN '"Device shared across multiple accounts"' END,
        CASE WHEN in_cluster THEN '"Part of suspicious transaction cluster"' END,
        CASE WHEN a > 0.7 THEN '"Unusual transaction behavior detected"' END) || ']' AS reasons_json
  FROM blend)"""


def _scored_sql(sql: str, *more: str) -> str:
    return _recursive(sql, ("fx_txn",), f"edges AS ({EDGES_CTE_SQL})", FIRSTS_CTE, HIST_CTE, CLUS_REACH, SCORED_CTE, *more)


@query("blend_score", _scored_sql("SELECT TransactionID AS transaction_id, risk_score, risk_level FROM final"))
def q_blend_score(spark, sf_dir):
    return scored_txn(spark, sf_dir).select(F.col("TransactionID").alias("transaction_id"), "risk_score", "risk_level")


@query("risk_reasons", _scored_sql("SELECT TransactionID AS transaction_id, reasons_json FROM final"))
def q_risk_reasons(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return s.select(F.col("TransactionID").alias("transaction_id"), R.reasons_json(F.col("reasons")).alias("reasons_json"))


@query("prediction_rows", _scored_sql(f"""
SELECT 'TXN-' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || upper(substr(md5(CAST(TransactionID AS VARCHAR)), 1, 4)) AS transaction_id,
       CAST(NULL AS BIGINT) AS user_id, CAST(coalesce(TransactionAmt, 0) AS DOUBLE) AS amount,
       CAST(coalesce(card1, 0) AS BIGINT) AS card1, coalesce(device, 'unknown') AS device,
       CAST(coalesce(addr1, 0) AS BIGINT) AS addr1, {PR("p", 4)} AS fraud_probability, risk_score,
       risk_level, CASE lower(risk_level) WHEN 'high' THEN 'flagged' WHEN 'medium' THEN 'review' ELSE 'safe' END AS status,
       reasons_json, ts AS created_at
FROM final"""))
def q_prediction_rows(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return reports.prediction_rows(s.withColumnRenamed("TransactionAmt", "amount"), id_col="TransactionID", ts="ts")


# ---------------------------------------------------------------- reports over fx_pred
def _pred(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_pred")


def _p(sql: str) -> str:
    return with_views(sql, "fx_pred")


A = f"TIMESTAMP '{ASOF}'"
LV = "lower(risk_level)"


@query("count_between", _p("""SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00'
    AND created_at < TIMESTAMP '2024-01-20 00:00:00') AS count FROM fx_pred"""))
def q_count_between(spark, sf_dir):
    return reports.count_between(_pred(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("average_risk", _p(f"SELECT {PR('coalesce(avg(risk_score), 0)', 2)} AS avg_risk_score FROM fx_pred"))
def q_average_risk(spark, sf_dir):
    return reports.average_risk(_pred(spark, sf_dir))


@query("latest_timestamp", _p("SELECT max(created_at) AS latest_created_at FROM fx_pred"))
def q_latest_timestamp(spark, sf_dir):
    return reports.latest_timestamp(_pred(spark, sf_dir))


@query("daily_risk_counts", _p(f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (WHERE {LV} = 'high') AS high,
    count(*) FILTER (WHERE {LV} = 'medium') AS medium, count(*) FILTER (WHERE {LV} = 'low') AS low FROM fx_pred GROUP BY 1"""))
def q_daily_risk_counts(spark, sf_dir):
    return reports.daily_risk_counts(_pred(spark, sf_dir))


RATE_SQL = (f"CASE WHEN count(*) = 0 THEN 0.0 ELSE {PR(f'count(*) FILTER (WHERE {LV} = ' + chr(39) + 'high' + chr(39) + ') / count(*) * 100', 1)} END")


@query("dashboard_kpis", _p(f"""
SELECT total_scanned, scanned_today, scanned_yesterday, greatest(scanned_today - scanned_yesterday, 0) AS delta_scanned,
       fraud_detected, under_review, detection_rate FROM (
  SELECT count(*) AS total_scanned,
         count(*) FILTER (WHERE created_at >= date_trunc('day', {A})) AS scanned_today,
         count(*) FILTER (WHERE created_at >= date_trunc('day', {A}) - INTERVAL 1 DAY
                          AND created_at < date_trunc('day', {A})) AS scanned_yesterday,
         count(*) FILTER (WHERE {LV} = 'high') AS fraud_detected, count(*) FILTER (WHERE {LV} = 'medium') AS under_review,
         {RATE_SQL} AS detection_rate
  FROM fx_pred) k"""))
def q_dashboard_kpis(spark, sf_dir):
    return reports.dashboard_kpis(_pred(spark, sf_dir), ASOF)


@query("risk_breakdown", _p(f"""
SELECT high, med, low, high / greatest(high + med + low, 1) AS high_share, med / greatest(high + med + low, 1) AS med_share,
       low / greatest(high + med + low, 1) AS low_share FROM (
  SELECT count(*) FILTER (WHERE {LV} = 'high') AS high, count(*) FILTER (WHERE {LV} = 'medium') AS med,
         count(*) FILTER (WHERE {LV} = 'low') AS low FROM fx_pred) c"""))
def q_risk_breakdown(spark, sf_dir):
    return reports.risk_breakdown(_pred(spark, sf_dir))


@query("risk_over_time", _p(f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, strftime(d.day, '%a') AS label, coalesce(c.high, 0) AS high, coalesce(c.med, 0) AS med,
       coalesce(c.low, 0) AS low
FROM (SELECT unnest(generate_series(CAST({A} AS DATE) - INTERVAL 6 DAY, CAST({A} AS DATE), INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (WHERE {LV} = 'high') AS high,
                  count(*) FILTER (WHERE {LV} = 'medium') AS med, count(*) FILTER (WHERE {LV} = 'low') AS low
           FROM fx_pred GROUP BY 1) c ON c.day = strftime(d.day, '%Y-%m-%d')"""))
def q_risk_over_time(spark, sf_dir):
    return reports.risk_over_time(_pred(spark, sf_dir), ASOF)


LIST_COLS = """transaction_id AS id, amount, card1, device, coalesce(addr1, 0) AS addr1, replace(reasons_json, ', ', ',') AS reasons, fraud_probability, risk_score, risk_level AS risk,
       CASE lower(risk_level) WHEN 'high' THEN 'flagged' WHEN 'medium' THEN 'review' ELSE 'safe' END AS status,
       created_at, strftime(created_at, '%H:%M') AS time, strftime(created_at, '%Y-%m-%d %H:%M') AS date"""


def _reasons_text(listed):
    """The list of reasons as text, which both engines' frames show alike."""
    return listed.withColumn("reasons", F.to_json("reasons"))


@query("list_transactions", _p(f"""SELECT {LIST_COLS} FROM fx_pred WHERE {LV} = 'high' AND lower(device) = 'mobile'
ORDER BY created_at DESC, transaction_id DESC LIMIT 50"""))
def q_list_transactions(spark, sf_dir):
    return _reasons_text(reports.list_transactions(_pred(spark, sf_dir), 50, risk="High", device="Mobile"))


@query("recent_transactions", _p(f"SELECT {LIST_COLS} FROM fx_pred ORDER BY created_at DESC, transaction_id DESC LIMIT 5"))
def q_recent_transactions(spark, sf_dir):
    return _reasons_text(reports.list_transactions(_pred(spark, sf_dir), 5))


@query("search_transactions", _p("""SELECT * FROM fx_pred WHERE lower(CAST(transaction_id AS VARCHAR)) LIKE '%42%'
    OR lower(coalesce(device, '')) LIKE '%42%' OR coalesce(CAST(card1 AS VARCHAR), '') LIKE '%42%'"""))
def q_search_transactions(spark, sf_dir):
    return reports.search_transactions(_pred(spark, sf_dir), "42")


@query("alerts", _p(f"""
SELECT title, sub, urgent FROM (
  SELECT * FROM (SELECT 0 AS g, created_at, transaction_id, 'High-risk transaction detected' AS title,
      CAST(transaction_id AS VARCHAR) || ' scored ' || CAST(CAST(round_even(risk_score, 0) AS BIGINT) AS VARCHAR) || ' on '
      || coalesce(device, 'None') AS sub, true AS urgent
    FROM fx_pred WHERE {LV} = 'high' ORDER BY created_at DESC, transaction_id DESC LIMIT 3) h
  UNION ALL
  SELECT * FROM (SELECT 1, created_at, transaction_id, 'Manual review suggested',
      CAST(transaction_id AS VARCHAR) || ' has ' || CAST(json_array_length(reasons_json) AS VARCHAR) || ' triggered rules', false
    FROM fx_pred WHERE {LV} = 'medium' ORDER BY created_at DESC, transaction_id DESC LIMIT 2) m
) u ORDER BY g, created_at DESC, transaction_id DESC LIMIT 4"""))
def q_alerts(spark, sf_dir):
    return reports.alerts(_pred(spark, sf_dir))


@query("analytics_snapshot", _p(f"""
SELECT {PR('coalesce(avg_score, 0)', 2)} AS avg_risk_score,
       greatest(1.0, {PR('(high + med) / 2', 1)}) AS avg_cluster_size,
       {PR('greatest(0.5, 100.0 - rate) / 20', 1)} AS false_positive_proxy, rate AS detection_rate
FROM (SELECT avg(risk_score) AS avg_score, count(*) FILTER (WHERE {LV} = 'high') AS high,
             count(*) FILTER (WHERE {LV} = 'medium') AS med, {RATE_SQL} AS rate FROM fx_pred) s"""))
def q_analytics_snapshot(spark, sf_dir):
    return reports.analytics_snapshot(_pred(spark, sf_dir))


@query("count_by_level", _p(f"""SELECT count(*) FILTER (WHERE {LV} = 'medium' AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
    AND created_at < TIMESTAMP '2024-01-25 00:00:00') AS count FROM fx_pred"""))
def q_count_by_level(spark, sf_dir):
    return reports.count_by_level(_pred(spark, sf_dir), "MEDIUM", "2024-01-05 00:00:00", "2024-01-25 00:00:00")


# ---------------------------------------------------------------- reports from the rollup of arriving predictions
def _rolled(spark, sf_dir):
    """fx_pred written by day in three batches, with its rollup increments."""
    folder = scratch_path(spark, "rolled")
    table = Increments(f"{folder}/rollup", rollup.SCHEMA, ["day", "level"], rollup.MERGE, buckets=1)
    pred = materialised(_pred(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("transaction_id"), F.lit(3))).withColumn("day", F.to_date("created_at")), "predictions")
    pred.write.partitionBy("batch", "day").parquet(f"{folder}/predictions")
    for batch in range(3):
        table.write(rollup.daily_rollup(pred.where(F.col("batch") == batch)), batch)
    return spark.read.parquet(f"{folder}/predictions").drop("batch"), table.before(spark, 3)


@query("kpis_from_rollup", ORACLES["dashboard_kpis"])
def q_kpis_from_rollup(spark, sf_dir):
    return rollup.dashboard_kpis(_rolled(spark, sf_dir)[1], ASOF)


@query("over_time_from_rollup", ORACLES["risk_over_time"])
def q_over_time_from_rollup(spark, sf_dir):
    return rollup.risk_over_time(_rolled(spark, sf_dir)[1], ASOF)


@query("breakdown_from_rollup", ORACLES["risk_breakdown"])
def q_breakdown_from_rollup(spark, sf_dir):
    return rollup.risk_breakdown(_rolled(spark, sf_dir)[1])


@query("snapshot_from_rollup", ORACLES["analytics_snapshot"])
def q_snapshot_from_rollup(spark, sf_dir):
    return rollup.analytics_snapshot(_rolled(spark, sf_dir)[1])


@query("daily_from_rollup", ORACLES["daily_risk_counts"])
def q_daily_from_rollup(spark, sf_dir):
    return rollup.daily_risk_counts(_rolled(spark, sf_dir)[1])


@query("recent_pruned", ORACLES["recent_transactions"])
def q_recent_pruned(spark, sf_dir):
    return _reasons_text(rollup.list_transactions(*_rolled(spark, sf_dir), 5))


@query("list_pruned", ORACLES["list_transactions"])
def q_list_pruned(spark, sf_dir):
    return _reasons_text(rollup.list_transactions(*_rolled(spark, sf_dir), 50, risk="High", device="Mobile"))


@query("alerts_pruned", ORACLES["alerts"])
def q_alerts_pruned(spark, sf_dir):
    return rollup.alerts(*_rolled(spark, sf_dir))
