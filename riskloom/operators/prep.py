"""Frame-level feature operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType)

from riskloom.functions import features as X

# Feature names of the final flow and of the earlier prototype.
FINAL_NAMES = {"mean_diff": "card1_amount_mean_diff", "zscore": "card1_amount_zscore",
               "ratio": "product_amount_ratio"}
PROTOTYPE_NAMES = {"mean_diff": "card1_txn_amt_mean_diff", "zscore": "card1_txn_amt_zscore",
                   "ratio": "product_txn_amt_ratio"}


def left_enrich(transactions: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """every transaction kept; identity columns null where absent."""
    return transactions.join(identity, on=key, how="left")


def time_features(df: DataFrame, dt: str = "TransactionDT", amount: str = "TransactionAmt") -> DataFrame:
    """D1-D3."""
    return df.select("*", X.transaction_hour(F.col(dt)).alias("transaction_hour"),
                     X.transaction_day(F.col(dt)).alias("transaction_day"),
                     X.log_amount(F.col(amount)).alias("log_transaction_amt"))


def group_amount_stats(df: DataFrame, key: str, amount: str = "TransactionAmt", stats_from: DataFrame | None = None) -> DataFrame:
    """G3 as aggregate + join: per-key mean and sample std. ``groupBy`` combines partially on the
    map side, so a hot key costs one small row per partition; the join back is left to AQE, which
    broadcasts the aggregate once its measured size is small and splits skewed partitions otherwise.
    Null keys find no match and get null statistics (N1, N2). ``stats_from``: the same rows from
    nearer the scan (before joins), of which only the two columns are read."""
    stats = (df if stats_from is None else stats_from).groupBy(key).agg(F.avg(F.col(amount).cast("double")).alias(f"_{key}_mean"),
                                F.stddev_samp(F.col(amount).cast("double")).alias(f"_{key}_std"))
    return df.join(stats, on=key, how="left")


def card_amount_features(df: DataFrame, key: str = "card1", amount: str = "TransactionAmt",
                         names: dict | None = None, stats_from: DataFrame | None = None) -> DataFrame:
    """Difference from the card mean and z-score (zero std -> null), float32."""
    names = names or FINAL_NAMES
    j = group_amount_stats(df, key, amount, stats_from)
    amt = F.col(amount).cast("double")
    mean, std = F.col(f"_{key}_mean"), F.col(f"_{key}_std")
    return j.select(*df.columns, X.float32(amt - mean).alias(names["mean_diff"]),
                    X.float32((amt - mean) / F.nullif(std, F.lit(0.0))).alias(names["zscore"]))


def product_amount_ratio(df: DataFrame, key: str = "ProductCD", amount: str = "TransactionAmt",
                         names: dict | None = None, stats_from: DataFrame | None = None) -> DataFrame:
    """Amount over the product mean, zero mean -> null, float32."""
    names = names or FINAL_NAMES
    stats = (df if stats_from is None else stats_from).groupBy(key).agg(F.avg(F.col(amount).cast("double")).alias("_prod_mean"))
    j = df.join(stats, on=key, how="left")
    return j.select(*df.columns, X.float32(F.col(amount).cast("double")
                                           / F.nullif(F.col("_prod_mean"), F.lit(0.0))).alias(names["ratio"]))


def match_flags(df: DataFrame) -> DataFrame:
    """D7, D8 (each only when its inputs exist)."""
    out = df
    if {"P_emaildomain", "R_emaildomain"} <= set(df.columns):
        out = out.withColumn("email_domain_match",
                             X.email_domain_match(F.col("P_emaildomain"), F.col("R_emaildomain")))
    if {"addr1", "addr2"} <= set(df.columns):
        out = out.withColumn("has_full_address", X.has_full_address(F.col("addr1"), F.col("addr2")))
    return out


def device_flags(df: DataFrame) -> DataFrame:
    """D9, D10, only when both device columns exist."""
    if not {"DeviceType", "DeviceInfo"} <= set(df.columns):
        return df
    return df.select("*", X.device_info_missing(F.col("DeviceInfo")).alias("device_info_missing"),
                     X.is_mobile_device(F.col("DeviceType")).alias("is_mobile_device"))


def add_ieee_features(df: DataFrame, prototype: bool = False, stats_from: DataFrame | None = None) -> DataFrame:
    """D1-D10 in the reference's order; a feature is added only when its inputs exist. The prototype
    flow names D4-D6 differently and has no D1/D3 (its hour is absent too; only the day exists).
    The group statistics come from ``stats_from`` (default: ``df`` itself, before any join back)."""
    stats_from = df if stats_from is None else stats_from
    cols = set(df.columns)
    names = PROTOTYPE_NAMES if prototype else FINAL_NAMES
    out = df
    if {"TransactionDT", "TransactionAmt"} <= cols:
        if prototype:
            out = out.withColumn("transaction_day", X.transaction_day(F.col("TransactionDT")))
        else:
            out = time_features(out)
    if {"TransactionAmt", "card1"} <= cols:
        out = card_amount_features(out, names=names, stats_from=stats_from)
    if {"TransactionAmt", "ProductCD"} <= cols:
        out = product_amount_ratio(out, names=names, stats_from=stats_from)
    out = match_flags(out)
    return device_flags(out)


def payment_features(df: DataFrame) -> DataFrame:
    """D11-D16."""
    typ = F.coalesce(F.col("type"), F.lit("UNKNOWN"))
    return df.withColumn("type", typ).select(
        "*",
        X.log_amount(F.col("amount")).alias("log_amount"),
        X.float32(F.col("oldbalanceOrg") - F.col("newbalanceOrig")).alias("origin_balance_delta"),
        X.float32(F.col("newbalanceDest") - F.col("oldbalanceDest")).alias("destination_balance_delta"),
        X.flag_equals(F.col("type"), "CASH_OUT").alias("is_cashout"),
        X.flag_equals(F.col("type"), "TRANSFER").alias("is_transfer"),
        X.account_pair(F.col("nameOrig"), F.col("nameDest")).alias("account_pair"))


_INT_TYPES = [("int8", ByteType(), -(1 << 7), (1 << 7) - 1), ("int16", ShortType(), -(1 << 15), (1 << 15) - 1),
              ("int32", IntegerType(), -(1 << 31), (1 << 31) - 1), ("int64", LongType(), None, None)]
FLOAT_TOLERANCE = 5e-4   # library rule: float32 kept when every value moves by at most this much


def narrow_type_plan(df: DataFrame) -> dict[str, str]:
    """D17 decision: per numeric column the smallest type that holds it, from one aggregate pass.
    Integers: smallest signed width covering min..max. Doubles: float32 when no value moves by
    more than 5e-4 (and none overflows)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType))]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    flts = [f.name for f in df.schema.fields if isinstance(f.dataType, FloatType)]
    aggs = []
    for i, c in enumerate(ints):
        aggs += [F.min(c).alias(f"i{i}_lo"), F.max(c).alias(f"i{i}_hi")]
    for i, c in enumerate(dbls):
        err = F.abs(F.col(c).cast("float").cast("double") - F.col(c))
        bad = F.when(F.col(c).isNotNull() & (F.isnan(err) | (err > FLOAT_TOLERANCE)), 1).otherwise(0)
        aggs.append(F.max(bad).alias(f"d{i}_bad"))
    plan = {c: "float32" for c in flts}
    if not aggs:
        return plan
    row = df.agg(*aggs).first()
    for i, c in enumerate(ints):
        lo, hi = row[f"i{i}_lo"], row[f"i{i}_hi"]
        for name, _t, tlo, thi in _INT_TYPES:
            if tlo is None or lo is None or (lo >= tlo and hi <= thi):
                plan[c] = name
                break
    for i, c in enumerate(dbls):
        plan[c] = "float64" if (row[f"d{i}_bad"] or 0) else "float32"
    return plan


_SPARK_OF = {"int8": "byte", "int16": "short", "int32": "int", "int64": "long",
             "float32": "float", "float64": "double"}


def narrow_types(df: DataFrame, plan: dict[str, str] | None = None) -> DataFrame:
    """Cast every numeric column to its narrowed type in one projection."""
    plan = plan if plan is not None else narrow_type_plan(df)
    return df.select(*[F.col(c).cast(_SPARK_OF[plan[c]]).alias(c) if c in plan else F.col(c)
                       for c in df.columns])


def scoring_features(df: DataFrame, amount: str = "TransactionAmt", device: str = "device",
                     addr1: str = "addr1") -> DataFrame:
    """The serving feature set; absent inputs take the reference defaults."""
    def opt(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    amt = opt(amount, 0).cast("double")
    dev = opt(device, "unknown")
    return df.select(
        "*",
        amt.alias("f_TransactionAmt"),
        opt("card1", 0).cast("long").alias("f_card1"),
        opt("transaction_hour", 12).cast("int").alias("f_transaction_hour"),
        opt("transaction_day", 15).cast("int").alias("f_transaction_day"),
        F.log1p(amt).alias("f_log_transaction_amt"),
        (dev == "mobile").cast("int").alias("f_is_mobile_device"),
        (dev == "unknown").cast("int").alias("f_device_info_missing"),
        (X.has_address_truthy(F.col(addr1)) if addr1 in df.columns else F.lit(0)).alias("f_has_full_address"),
        F.lit(0).alias("f_email_domain_match"),
        F.lit(1.0).alias("f_product_amount_ratio"))


SCORING_FEATURES = ["TransactionAmt", "card1", "transaction_hour", "transaction_day", "log_transaction_amt",
                    "is_mobile_device", "device_info_missing", "has_full_address", "email_domain_match",
                    "product_amount_ratio"]


def align_features(df: DataFrame, model_columns: Sequence[str], keep: Sequence[str] = (),
                   prefixes: Sequence[str] = ("g_", "f_", ""), out_prefix: str = "") -> DataFrame:
    """Exactly the model's columns in its order; absent -> 0; extras dropped. A name is looked
    up with precedence graph (``g_``) > engineered (``f_``) > raw, as the reference's dict merge."""
    cols = set(df.columns)
    out = [F.col(k) for k in keep]
    for name in model_columns:
        src = next((p + name for p in prefixes if p + name in cols), None)
        out.append((F.col(src).cast("double") if src else F.lit(0.0)).alias(out_prefix + name))
    return df.select(*out)
