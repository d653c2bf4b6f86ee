"""Payment graph aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payment_edges(df: DataFrame) -> DataFrame:
    """G1: per (source, target) pair; null endpoints dropped (N21); ``count(step)`` skips nulls.
    One groupBy, combined partially on the map side."""
    return (df.where(F.col("nameOrig").isNotNull() & F.col("nameDest").isNotNull())
            .groupBy(F.col("nameOrig").alias("source"), F.col("nameDest").alias("target"))
            .agg(F.count("step").alias("transaction_count"),
                 F.sum("amount").alias("total_amount"),
                 F.sum(F.col("isFraud").cast("long")).alias("fraud_count"),
                 F.sum(F.col("isFlaggedFraud").cast("long")).alias("flagged_count"),
                 F.min("step").alias("first_step"),
                 F.max("step").alias("last_step")))


def stack_endpoints(df: DataFrame) -> DataFrame:
    """Bag union of both ends, renamed to a common node schema."""
    src = df.select(F.col("nameOrig").alias("node_id"), F.col("oldbalanceOrg").alias("balance_before"),
                    F.col("newbalanceOrig").alias("balance_after"))
    dst = df.select(F.col("nameDest").alias("node_id"), F.col("oldbalanceDest").alias("balance_before"),
                    F.col("newbalanceDest").alias("balance_after"))
    return src.unionByName(dst)


def payment_nodes(df: DataFrame) -> DataFrame:
    """Per account: observations and mean balances before / after; null ids dropped."""
    return (stack_endpoints(df).where(F.col("node_id").isNotNull())
            .groupBy("node_id")
            .agg(F.count(F.lit(1)).alias("observations"),
                 F.avg("balance_before").alias("avg_balance_before"),
                 F.avg("balance_after").alias("avg_balance_after")))
