"""Risk scoring operators (L1-L4). L5 is composed in ``riskloom.plans.score``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rules as R


def rule_score(df: DataFrame, amount: str = "TransactionAmt", device: str = "device",
               addr1: str = "addr1") -> DataFrame:
    """L1: adds ``rule_score`` and the ordered ``rule_reasons`` array. A column that is absent reads
    as missing (amount 0, device ``unknown``, address None)."""
    amt = F.col(amount) if amount in df.columns else F.lit(None).cast("double")
    dev = F.col(device) if device in df.columns else F.lit(None).cast("string")
    adr = F.col(addr1) if addr1 in df.columns else F.lit(None).cast("int")
    return df.select("*", R.rule_points(amt, dev, adr).alias("rule_score"),
                     R.rule_reasons(amt, dev, adr).alias("rule_reasons"))


def blend(df: DataFrame, probability: str = "fraud_probability", anomaly: str = "anomaly_score",
          rule: str = "rule_score", graph: str = "graph_score", cluster: str = "in_cluster") -> DataFrame:
    """L2 + L3: ``risk_score`` (rounded) and ``risk_level``."""
    score = R.blended_score(F.col(probability), F.col(rule), F.col(anomaly), F.col(graph),
                            F.coalesce(F.col(cluster), F.lit(False)))
    return (df.withColumn("risk_score", score)
              .withColumn("risk_level", R.risk_level(F.col("risk_score"))))


def reasons(df: DataFrame, amount: str = "TransactionAmt", device: str = "device", addr1: str = "addr1",
            user_edges: str = "user_edges_incl", device_users: str = "device_users_incl",
            cluster: str = "in_cluster", anomaly: str = "anomaly_score") -> DataFrame:
    """L4: the full ordered reason list."""
    adr = F.col(addr1) if addr1 in df.columns else F.lit(None).cast("int")
    return df.withColumn("reasons", R.all_reasons(
        F.col(amount), F.col(device), adr, F.col(user_edges), F.col(device_users),
        F.coalesce(F.col(cluster), F.lit(False)), F.col(anomaly)))
