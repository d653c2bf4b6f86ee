"""Query keys for rule scoring (L1) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import scoring
from riskloom.plans.registry import query
from riskloom.sources.fixtures import fixture, with_views

RULE_POINTS_SQL = """
 (CASE WHEN coalesce(TransactionAmt, 0) > 5000 THEN 40 WHEN coalesce(TransactionAmt, 0) > 1000 THEN 25 ELSE 0 END
  + CASE WHEN coalesce(device, 'unknown') = 'unknown' THEN 15 ELSE 0 END
  + CASE WHEN addr1 IS NULL THEN 10 ELSE 0 END
  + CASE WHEN coalesce(device, 'unknown') = 'mobile' THEN 5 ELSE 0 END)"""

RULE_REASON_ITEMS_SQL = """
  CASE WHEN coalesce(TransactionAmt, 0) > 5000 THEN '"Very high transaction amount"'
       WHEN coalesce(TransactionAmt, 0) > 1000 THEN '"High transaction amount"' END,
  CASE WHEN coalesce(device, 'unknown') = 'unknown' THEN '"Unknown device"' END,
  CASE WHEN addr1 IS NULL THEN '"Missing address"' END,
  CASE WHEN coalesce(device, 'unknown') = 'mobile' THEN '"Mobile device usage"' END"""


@query("rule_score", with_views(f"""
SELECT TransactionID, {RULE_POINTS_SQL} AS rule_score,
       '[' || concat_ws(', ', {RULE_REASON_ITEMS_SQL}) || ']' AS reasons_json
FROM fx_txn""", "fx_txn"))
def q_rule_score(spark, sf_dir):
    txn = fixture(spark, sf_dir, "fx_txn")
    return (scoring.rule_score(txn)
            .select("TransactionID", "rule_score", R.reasons_json(F.col("rule_reasons")).alias("reasons_json")))
