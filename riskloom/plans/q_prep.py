"""Query keys for scans, sampling, profiling, features, cleaning and encoding (A1, B, C, D, E, F1, G1, G2)."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import cleaning, payments, prep, profiling, sampling, sketches
from riskloom.operators.preprocessor import ModelPreprocessor
from riskloom.plans import prepare
from riskloom.plans.registry import ORACLES, query
from riskloom.session import scratch_path
from riskloom.sources.fixtures import fixture, with_views
from riskloom.sources.tables import materialised, read_csv_by_name, read_table, table

MERGED_COLS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "ProductCD", "addr1", "addr2",
               "P_emaildomain", "R_emaildomain", "dist1", "isFraud", "DeviceType", "DeviceInfo"]
CATEGORICAL = ["ProductCD", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo"]
FEATURE_COLS = ["transaction_hour", "transaction_day", "log_transaction_amt", "card1_amount_mean_diff",
                "card1_amount_zscore", "product_amount_ratio", "email_domain_match", "has_full_address",
                "device_info_missing", "is_mobile_device"]


NULLABLE_INTS = ["card1", "addr1", "addr2"]
INTS_AS_DOUBLE_SQL = "* REPLACE (CAST(card1 AS DOUBLE) AS card1, CAST(addr1 AS DOUBLE) AS addr1, CAST(addr2 AS DOUBLE) AS addr2)"


def _ints_as_double(df):
    """Output projection of a few keys: nullable integer columns as double, so a null compares the
    same way on both engines' result frames."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in NULLABLE_INTS else F.col(c) for c in df.columns])


def _merged(spark, sf_dir):
    return prep.left_enrich(fixture(spark, sf_dir, "fx_ieee"), fixture(spark, sf_dir, "fx_identity"))


def _with(sql: str, *extra: str) -> str:
    """DuckDB text with the fixture CTEs plus extra CTEs (given as 'name AS (...)')."""
    base = with_views("SELECT 1", "fx_ieee", "fx_identity", "fx_pay", "fx_txn")
    base = base[: base.rfind("\nSELECT 1")]
    parts = [base] + [f",\n{e}" for e in extra]
    return "".join(parts) + "\n" + sql


MERGED_CTE = """merged AS (SELECT i.*, d.DeviceType, d.DeviceInfo FROM fx_ieee i LEFT JOIN fx_identity d
    ON i.TransactionID = d.TransactionID)"""

FEAT_CTE = """feat AS (SELECT m.*,
    CAST(CAST(floor(TransactionDT / 3600.0) AS BIGINT) % 24 AS SMALLINT) AS transaction_hour,
    CAST(floor(TransactionDT / 86400.0) AS INTEGER) AS transaction_day,
    CAST(ln(1 + TransactionAmt) AS FLOAT) AS log_transaction_amt,
    CASE WHEN card1 IS NULL THEN NULL ELSE CAST(TransactionAmt - avg(TransactionAmt) OVER (PARTITION BY card1) AS FLOAT) END
      AS card1_amount_mean_diff,
    CASE WHEN card1 IS NULL THEN NULL ELSE CAST((TransactionAmt - avg(TransactionAmt) OVER (PARTITION BY card1))
      / nullif(stddev_samp(TransactionAmt) OVER (PARTITION BY card1), 0) AS FLOAT) END AS card1_amount_zscore,
    CASE WHEN ProductCD IS NULL THEN NULL ELSE CAST(TransactionAmt / nullif(avg(TransactionAmt) OVER (PARTITION BY ProductCD), 0)
      AS FLOAT) END AS product_amount_ratio,
    CAST(coalesce(P_emaildomain, 'missing') = coalesce(R_emaildomain, 'missing') AS TINYINT) AS email_domain_match,
    CAST(addr1 IS NOT NULL AND addr2 IS NOT NULL AS TINYINT) AS has_full_address,
    CAST(DeviceInfo IS NULL AS TINYINT) AS device_info_missing,
    CAST(lower(coalesce(DeviceType, '')) = 'mobile' AS TINYINT) AS is_mobile_device
  FROM merged m)"""

SPLIT_CTE = """split AS (SELECT s.*, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT m.*, row_number() OVER (PARTITION BY isFraud ORDER BY md5(concat(CAST(TransactionID AS VARCHAR), ':42')),
               TransactionID) AS rn, count(*) OVER (PARTITION BY isFraud) AS n FROM {src} m) s)"""


def _null_ratio_union(src: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS ratio FROM {src}"
        for c in cols)


# ---------------------------------------------------------------- A1 scan
ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@query("src_scan", "SELECT * FROM orders")
def q_src_scan(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/orders.parquet", schema=ORDERS_SCHEMA)


# ---------------------------------------------------------------- B1, B2
@query("sample_n", with_views(f"""
SELECT {INTS_AS_DOUBLE_SQL} FROM fx_ieee ORDER BY md5(concat(CAST(TransactionID AS VARCHAR), ':42')), TransactionID LIMIT 1000""", "fx_ieee"))
def q_sample_n(spark, sf_dir):
    return _ints_as_double(sampling.sample_n(fixture(spark, sf_dir, "fx_ieee"), 1000, seed=42, key="TransactionID"))


@query("stratified_split", _with("SELECT TransactionID, isFraud, split FROM split",
                                 SPLIT_CTE.format(src="fx_ieee")))
def q_stratified_split(spark, sf_dir):
    return sampling.stratified_split(fixture(spark, sf_dir, "fx_ieee"), "isFraud", 0.2, 42) \
        .select("TransactionID", "isFraud", "split")


MEDIAN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


@query("appended_median", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(median({c}) AS DOUBLE) AS median FROM lineitem" for c in MEDIAN_COLS))
def q_appended_median(spark, sf_dir):
    """E2, E5 on appended data: the rows of lineitem arrive in four parts, the first of which sets the grid; each is counted once, and
    the medians of them all are exact."""
    rows = table(spark, sf_dir, "lineitem").select(*MEDIAN_COLS, F.pmod("l_orderkey", F.lit(4)).alias("part"))
    grid = sketches.quantile_grid(rows.where(F.col("part") == 0), MEDIAN_COLS)
    stored = [materialised(sketches.cell_counts(rows.where(F.col("part") == k), grid, "part"), "cells") for k in range(4)]
    found = sketches.appended_medians(rows, functools.reduce(DataFrame.unionByName, stored), grid)
    return spark.createDataFrame(sorted(found.items()), "column_name string, median double")


@query("csv_by_name", """
SELECT CASE WHEN bad THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS o_orderkey, CASE WHEN bad THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS o_custkey,
       CASE WHEN bad THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN bad OR o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       bad, CASE WHEN bad THEN 1 ELSE 0 END AS lines_kept
FROM (SELECT *, o_orderkey % 3 = 2 AND o_orderkey % 50 IN (0, 1, 2) AS bad FROM orders)""")
def q_csv_by_name(spark, sf_dir):
    """A1: the orders as three groups of CSV files: one in order, one reversed and without a column, one with short, long and
    mistyped rows."""
    orders = materialised(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders")
    folder = scratch_path(spark, "csv")
    text = lambda *cols: F.concat_ws(",", *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))
    plain, turned = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ("o_orderstatus", "o_custkey", "o_orderkey")
    planted = (F.when(F.col("o_orderkey") % 50 == 0, text("o_orderkey", "o_custkey"))
               .when(F.col("o_orderkey") % 50 == 1, text(*plain, F.lit("more")))
               .when(F.col("o_orderkey") % 50 == 2, text("o_orderkey", F.lit("no number"), "o_orderstatus", "o_orderpriority")).otherwise(text(*plain)))
    for part, (names, line) in enumerate(((plain, text(*plain)), (turned, text(*turned)), (plain, planted))):
        rows = orders.where(F.col("o_orderkey") % 3 == part).select(line.alias(",".join(names)))
        rows.write.option("header", "true").option("quote", "\u0000").option("sep", "\u0001").csv(f"{folder}/part={part}")
    found = read_csv_by_name(spark, f"{folder}/*/*.csv", "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    return found.select(F.col("o_orderkey").cast("double").alias("o_orderkey"), F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderstatus", "o_orderpriority", F.col("_corrupt_record").isNotNull().alias("bad"),
                        F.when(F.length("_corrupt_record") > 0, 1).otherwise(0).alias("lines_kept"))


# ---------------------------------------------------------------- C1-C3, G9
@query("null_ratio", _with(f"""
SELECT column_name, round(ratio, 4) AS missing_ratio FROM ({_null_ratio_union('merged', MERGED_COLS)}) u
ORDER BY ratio DESC, column_name LIMIT 20""", MERGED_CTE))
def q_null_ratio(spark, sf_dir):
    return profiling.null_ratio(_merged(spark, sf_dir), top=20)


@query("dataset_profile", _with(f"""
SELECT 'ieee_merged' AS dataset_name, count(*) AS rows, 13 AS columns, 'isFraud' AS label_column,
       avg(CAST(isFraud AS DOUBLE)) AS label_rate, 8 AS numeric_columns, 5 AS categorical_columns,
       (SELECT string_agg(column_name || '=' || CAST(CAST(round(ratio * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY ratio DESC, column_name)
        FROM ({_null_ratio_union('merged', MERGED_COLS)}) u) AS top_missing_columns
FROM merged""", MERGED_CTE))
def q_dataset_profile(spark, sf_dir):
    p = profiling.dataset_profile(_merged(spark, sf_dir), "isFraud", "ieee_merged", "test")
    top = F.transform("top_missing_columns", lambda c: F.concat(c["column"], F.lit("="), F.round(c["missing_ratio"] * 10000).cast("long").cast("string")))
    return p.select("dataset_name", "rows", "columns", "label_column", "label_rate", "numeric_columns",
                    "categorical_columns", F.array_join(top, ",").alias("top_missing_columns"))


@query("label_rate", with_views("SELECT avg(CAST(isFraud AS DOUBLE)) AS label_rate FROM fx_ieee", "fx_ieee"))
def q_label_rate(spark, sf_dir):
    return profiling.label_rate(fixture(spark, sf_dir, "fx_ieee"), "isFraud")


@query("value_shares", _with("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, coalesce({c}, 'missing') AS value, count(*) AS n, "
    f"count(*) / (SELECT count(*) FROM merged) AS share FROM merged GROUP BY 2" for c in CATEGORICAL), MERGED_CTE))
def q_value_shares(spark, sf_dir):
    return cleaning.value_shares(_merged(spark, sf_dir), CATEGORICAL)


# ---------------------------------------------------------------- D1-D10, F1
@query("left_enrich", _with(f"SELECT {INTS_AS_DOUBLE_SQL} FROM merged", MERGED_CTE))
def q_left_enrich(spark, sf_dir):
    return _ints_as_double(_merged(spark, sf_dir))


@query("time_features", _with("SELECT TransactionID, transaction_hour, transaction_day, log_transaction_amt FROM feat",
                              MERGED_CTE, FEAT_CTE))
def q_time_features(spark, sf_dir):
    return prep.time_features(fixture(spark, sf_dir, "fx_ieee")) \
        .select("TransactionID", "transaction_hour", "transaction_day", "log_transaction_amt")


@query("card_amount_features", _with("SELECT TransactionID, card1_amount_mean_diff, card1_amount_zscore FROM feat",
                                     MERGED_CTE, FEAT_CTE))
def q_card_amount_features(spark, sf_dir):
    return prep.card_amount_features(fixture(spark, sf_dir, "fx_ieee")) \
        .select("TransactionID", "card1_amount_mean_diff", "card1_amount_zscore")


@query("product_amount_ratio", _with("SELECT TransactionID, product_amount_ratio FROM feat", MERGED_CTE, FEAT_CTE))
def q_product_amount_ratio(spark, sf_dir):
    return prep.product_amount_ratio(fixture(spark, sf_dir, "fx_ieee")).select("TransactionID", "product_amount_ratio")


@query("match_flags", _with("SELECT TransactionID, email_domain_match, has_full_address FROM feat",
                            MERGED_CTE, FEAT_CTE))
def q_match_flags(spark, sf_dir):
    return prep.match_flags(fixture(spark, sf_dir, "fx_ieee")) \
        .select("TransactionID", "email_domain_match", "has_full_address")


@query("device_flags", _with("SELECT TransactionID, device_info_missing, is_mobile_device FROM feat",
                             MERGED_CTE, FEAT_CTE))
def q_device_flags(spark, sf_dir):
    return prep.device_flags(_merged(spark, sf_dir)).select("TransactionID", "device_info_missing", "is_mobile_device")


@query("ieee_features", _with(f"SELECT {INTS_AS_DOUBLE_SQL} FROM feat", MERGED_CTE, FEAT_CTE))
def q_ieee_features(spark, sf_dir):
    return _ints_as_double(prep.add_ieee_features(_merged(spark, sf_dir), stats_from=fixture(spark, sf_dir, "fx_ieee")))


# ---------------------------------------------------------------- D11-D17 payments
PAY_FEAT_CTE = """payf AS (SELECT step, coalesce(type, 'UNKNOWN') AS type, amount, nameOrig, oldbalanceOrg, newbalanceOrig,
    nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud,
    CAST(ln(1 + amount) AS FLOAT) AS log_amount,
    CAST(oldbalanceOrg - newbalanceOrig AS FLOAT) AS origin_balance_delta,
    CAST(newbalanceDest - oldbalanceDest AS FLOAT) AS destination_balance_delta,
    CAST(coalesce(type, 'UNKNOWN') = 'CASH_OUT' AS TINYINT) AS is_cashout,
    CAST(coalesce(type, 'UNKNOWN') = 'TRANSFER' AS TINYINT) AS is_transfer,
    nameOrig || '->' || nameDest AS account_pair
  FROM fx_pay)"""


@query("payment_features", _with("SELECT * FROM payf", PAY_FEAT_CTE))
def q_payment_features(spark, sf_dir):
    return prep.payment_features(fixture(spark, sf_dir, "fx_pay"))


PAY_INTS = ["step", "isFraud", "isFlaggedFraud", "is_cashout", "is_transfer"]
PAY_DOUBLES = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
PAY_FLOATS = ["log_amount", "origin_balance_delta", "destination_balance_delta"]


def _narrow_sql(src: str) -> str:
    parts = []
    for c in PAY_INTS:
        parts.append(f"SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'int8' "
                     f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'int16' "
                     f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int32' ELSE 'int64' END "
                     f"AS narrow_type FROM {src}")
    for c in PAY_DOUBLES:
        parts.append(f"SELECT '{c}' AS column_name, CASE WHEN max(CASE WHEN abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - {c})"
                     f" > 0.0005 THEN 1 ELSE 0 END) = 1 THEN 'float64' ELSE 'float32' END AS narrow_type FROM {src}")
    for c in PAY_FLOATS:
        parts.append(f"SELECT '{c}' AS column_name, 'float32' AS narrow_type")
    return "\nUNION ALL ".join(parts)


@query("narrow_types", _with(_narrow_sql("payf"), PAY_FEAT_CTE))
def q_narrow_types(spark, sf_dir):
    return _plan_frame(spark, prep.payment_features(fixture(spark, sf_dir, "fx_pay")))


def _plan_frame(spark, df):
    """The narrowing decision as a DataFrame (column_name, narrow_type)."""
    plan = prep.narrow_type_plan(df)
    rows = [(c, t) for c, t in plan.items()]
    return spark.createDataFrame(rows, "column_name string, narrow_type string")


# ---------------------------------------------------------------- G1, G2, C6
@query("payment_edges", _with("""
SELECT nameOrig AS source, nameDest AS target, count(step) AS transaction_count, sum(amount) AS total_amount,
       CAST(sum(isFraud) AS BIGINT) AS fraud_count, CAST(sum(isFlaggedFraud) AS BIGINT) AS flagged_count,
       min(step) AS first_step, max(step) AS last_step
FROM payf WHERE nameOrig IS NOT NULL AND nameDest IS NOT NULL GROUP BY 1, 2""", PAY_FEAT_CTE))
def q_payment_edges(spark, sf_dir):
    return payments.payment_edges(prep.payment_features(fixture(spark, sf_dir, "fx_pay")))


NODES_SQL = """
SELECT node_id, count(*) AS observations, avg(balance_before) AS avg_balance_before, avg(balance_after) AS avg_balance_after
FROM (SELECT nameOrig AS node_id, oldbalanceOrg AS balance_before, newbalanceOrig AS balance_after FROM payf
      UNION ALL SELECT nameDest, oldbalanceDest, newbalanceDest FROM payf) u
WHERE node_id IS NOT NULL GROUP BY node_id"""


@query("payment_nodes", _with(NODES_SQL, PAY_FEAT_CTE))
def q_payment_nodes(spark, sf_dir):
    return payments.payment_nodes(prep.payment_features(fixture(spark, sf_dir, "fx_pay")))


SAMPLED_PAY_CTE = """fx_pay AS (SELECT * EXCLUDE (_row_key) FROM fx_pay_keyed
    ORDER BY md5(concat(_row_key, ':42')), _row_key LIMIT 50000)"""


def _with_sampled_pay(sql: str) -> str:
    base = with_views("SELECT 1", "fx_pay_keyed")
    return ",\n".join([base[: base.rfind("\nSELECT 1")], SAMPLED_PAY_CTE, PAY_FEAT_CTE]) + "\n" + sql


@query("graph_profile", _with_sampled_pay(f"""
SELECT (SELECT count(*) FROM payf) AS rows, (SELECT avg(CAST(isFraud AS DOUBLE)) FROM payf) AS label_rate,
       (SELECT count(*) FROM ({NODES_SQL}) n) AS node_count,
       (SELECT count(*) FROM (SELECT DISTINCT nameOrig, nameDest FROM payf
                              WHERE nameOrig IS NOT NULL AND nameDest IS NOT NULL) e) AS edge_count"""))
def q_graph_profile(spark, sf_dir):
    g = prepare.prepare_payments(fixture(spark, sf_dir, "fx_pay_keyed"), sample_size=0)
    return g.profile.select("rows", "label_rate", "node_count", "edge_count")


# ---------------------------------------------------------------- D18-D20
SCORING_SQL_COLS = """TransactionID, CAST(coalesce(TransactionAmt, 0) AS DOUBLE) AS TransactionAmt,
       CAST(coalesce(card1, 0) AS BIGINT) AS card1, 12 AS transaction_hour, 15 AS transaction_day,
       ln(1 + coalesce(TransactionAmt, 0)) AS log_transaction_amt,
       CAST(coalesce(device, 'unknown') = 'mobile' AS INTEGER) AS is_mobile_device,
       CAST(coalesce(device, 'unknown') = 'unknown' AS INTEGER) AS device_info_missing,
       CAST(coalesce(addr1, 0) <> 0 AS INTEGER) AS has_full_address,
       0 AS email_domain_match, 1.0::DOUBLE AS product_amount_ratio"""


@query("scoring_features", with_views(f"SELECT {SCORING_SQL_COLS} FROM fx_txn", "fx_txn"))
def q_scoring_features(spark, sf_dir):
    f = prep.scoring_features(fixture(spark, sf_dir, "fx_txn"))
    return f.select("TransactionID", *[F.col("f_" + c).alias(c) for c in prep.SCORING_FEATURES])


ALIGN_COLS = ["TransactionAmt", "card1", "V1", "log_transaction_amt", "is_mobile_device", "has_full_address",
              "product_amount_ratio", "user_degree"]


@query("align_features", with_views(f"""
SELECT TransactionID, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c not in ("V1", "user_degree")
                                 else f"0.0::DOUBLE AS {c}" for c in ALIGN_COLS)}
FROM (SELECT {SCORING_SQL_COLS} FROM fx_txn) s""", "fx_txn"))
def q_align_features(spark, sf_dir):
    f = prep.scoring_features(fixture(spark, sf_dir, "fx_txn"))
    return prep.align_features(f, ALIGN_COLS, keep=["TransactionID"])


# ---------------------------------------------------------------- E1-E3
ALL_FEAT_COLS = MERGED_COLS + FEATURE_COLS


@query("drop_sparse", _with(f"""
SELECT column_name, ratio AS missing_ratio FROM ({_null_ratio_union('feat', ALL_FEAT_COLS)}) u WHERE ratio > 0.85""",
                            MERGED_CTE, FEAT_CTE))
def q_drop_sparse(spark, sf_dir):
    feat = prep.add_ieee_features(_merged(spark, sf_dir), stats_from=fixture(spark, sf_dir, "fx_ieee"))
    ratios = profiling.null_ratios_row(feat)
    _, dropped = cleaning.drop_sparse_columns(feat, 0.85, ratios)
    return spark.createDataFrame([(c, float(ratios[c])) for c in dropped], "column_name string, missing_ratio double")


IEEE_NULLABLE_NUM = ["card1", "addr1", "addr2", "dist1"]


@query("impute_median", with_views(f"""
SELECT TransactionID, TransactionDT, TransactionAmt, ProductCD, P_emaildomain, R_emaildomain, isFraud,
       {", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM fx_ieee)) AS {c}" for c in IEEE_NULLABLE_NUM)}
FROM fx_ieee""", "fx_ieee"))
def q_impute_median(spark, sf_dir):
    return cleaning.impute_median(fixture(spark, sf_dir, "fx_ieee"))


@query("impute_constant", _with(f"""
SELECT TransactionID, {", ".join(f"coalesce({c}, 'missing') AS {c}" for c in CATEGORICAL)} FROM merged""", MERGED_CTE))
def q_impute_constant(spark, sf_dir):
    return cleaning.impute_constant(_merged(spark, sf_dir).select("TransactionID", *CATEGORICAL), CATEGORICAL)


# ---------------------------------------------------------------- E4-E6 on the split merged frame
RARE_CTE = "rare AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, coalesce({c}, 'missing') AS value, "
    f"count(*) / (SELECT count(*) FROM split WHERE split = 'train') AS share "
    f"FROM split WHERE split = 'train' GROUP BY 2 HAVING count(*) / (SELECT count(*) FROM split WHERE split = 'train') < 0.005"
    for c in CATEGORICAL) + ")"


@query("rare_categories", _with("SELECT column_name, value, share FROM rare", MERGED_CTE,
                                SPLIT_CTE.format(src="merged"), RARE_CTE))
def q_rare_categories(spark, sf_dir):
    split = sampling.stratified_split(_merged(spark, sf_dir), "isFraud", 0.2, 42)
    return cleaning.rare_value_map(split.where("split = 'train'"), CATEGORICAL, 0.005)


MERGED_NUM = ["TransactionDT", "TransactionAmt", "card1", "addr1", "addr2", "dist1"]


@query("fit_apply_median", _with(f"""
SELECT TransactionID, {", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM split WHERE split = 'train')) AS {c}"
    if c in IEEE_NULLABLE_NUM else c for c in MERGED_NUM)}
FROM split WHERE split = 'validation'""", MERGED_CTE, SPLIT_CTE.format(src="merged")))
def q_fit_apply_median(spark, sf_dir):
    split = sampling.stratified_split(_merged(spark, sf_dir), "isFraud", 0.2, 42).select("TransactionID", "split", *MERGED_NUM)
    train = split.where("split = 'train'")
    med = cleaning.median_values(train, [c for c in IEEE_NULLABLE_NUM])
    return cleaning.apply_medians(split.where("split = 'validation'"), med).drop("split")


def _encoded_cte():
    # a null cell is not rewritten to rare, then becomes 'missing'
    reduced = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} IN (SELECT value FROM rare WHERE column_name = '{c}') "
        f"THEN 'rare' ELSE {c} END AS {c}" for c in CATEGORICAL)
    codes = "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT {c} AS v FROM reduced WHERE split = 'train') d" for c in CATEGORICAL)
    enc = ", ".join(
        f"CAST(coalesce((SELECT code FROM codes k WHERE k.column_name = '{c}' AND k.value = r.{c}), -1) AS DOUBLE) AS {c}"
        for c in CATEGORICAL)
    return (f"reduced AS (SELECT TransactionID, split, isFraud, {', '.join(MERGED_NUM)}, {reduced} FROM split)",
            f"codes AS ({codes})",
            f"encoded AS (SELECT TransactionID, split, isFraud, {', '.join(MERGED_NUM)}, {enc} FROM reduced r)")


@query("ordinal_encode", _with(f"SELECT TransactionID, split, {', '.join(CATEGORICAL)} FROM encoded",
                               MERGED_CTE, SPLIT_CTE.format(src="merged"), RARE_CTE, *_encoded_cte()))
def q_ordinal_encode(spark, sf_dir):
    split = sampling.stratified_split(_merged(spark, sf_dir), "isFraud", 0.2, 42)
    train = split.where("split = 'train'")
    rare = cleaning.rare_value_map(train, CATEGORICAL, 0.005)
    red = cleaning.impute_constant(cleaning.apply_rare(split, rare, CATEGORICAL, key="TransactionID"), CATEGORICAL)
    codes = cleaning.fit_code_table(red.where("split = 'train'"), CATEGORICAL)
    return cleaning.apply_codes(red, codes, CATEGORICAL).select("TransactionID", "split", *CATEGORICAL)


@query("model_ready", _with(f"""
SELECT TransactionID, split, {", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM split WHERE split = 'train')) AS {c}"
    for c in MERGED_NUM)}, {", ".join(CATEGORICAL)}, CAST(isFraud AS TINYINT) AS isFraud FROM encoded""",
                            MERGED_CTE, SPLIT_CTE.format(src="merged"), RARE_CTE, *_encoded_cte()))
def q_model_ready(spark, sf_dir):
    md = prepare.prepare_model_data(_merged(spark, sf_dir), keep_id=True)
    return md.frame


@query("preparation_report", _with(f"""
SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
       11 AS feature_count, 6 AS numeric_feature_count, 5 AS categorical_feature_count,
       avg(CASE WHEN split = 'train' THEN CAST(isFraud AS DOUBLE) END) AS train_fraud_rate,
       avg(CASE WHEN split = 'validation' THEN CAST(isFraud AS DOUBLE) END) AS validation_fraud_rate,
       (SELECT count(DISTINCT column_name) FROM rare) AS rare_category_columns,
       (SELECT string_agg(column_name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, column_name)
        FROM (SELECT column_name, count(*) AS n FROM rare GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t) AS top_rare_category_columns
FROM split""", MERGED_CTE, SPLIT_CTE.format(src="merged"), RARE_CTE))
def q_preparation_report(spark, sf_dir):
    md = prepare.prepare_model_data(_merged(spark, sf_dir))
    top = F.transform("top_rare_category_columns", lambda c: F.concat(c["column"], F.lit("="), c["rare_value_count"].cast("string")))
    return md.report.drop("source_path", "target_column").withColumn("top_rare_category_columns", F.nullif(F.array_join(top, ","), F.lit("")))


@query("preprocessor_reloaded", ORACLES["model_ready"])
def q_preprocessor_reloaded(spark, sf_dir):
    """Model data written, the fitted preprocessor read back in its pipeline, and applied to every raw row."""
    merged = _merged(spark, sf_dir)
    root = scratch_path(spark, "model-data")
    split = materialised(sampling.stratified_split(merged, "isFraud", 0.2, 42), "split")
    fitted = Pipeline(stages=[ModelPreprocessor(keep=["TransactionID", "split"])]).fit(split.where("split = 'train'"))
    fitted.write().overwrite().save(f"{root}/preprocessor")
    return PipelineModel.load(f"{root}/preprocessor").transform(split)


@query("top_rare_columns", _with("""
SELECT column_name, count(*) AS rare_value_count FROM rare GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
                                 MERGED_CTE, SPLIT_CTE.format(src="merged"), RARE_CTE))
def q_top_rare_columns(spark, sf_dir):
    md = prepare.prepare_model_data(_merged(spark, sf_dir))
    return profiling.top_rare_columns(md.rare_map)


# ---------------------------------------------------------------- E8, E9 (types as narrowed at sf0.01)
def _med(c: str, src: str = "feat") -> str:
    return f"(SELECT median(CAST({c} AS DOUBLE)) FROM {src})"


# numbers are compared as doubles (of float32 values where the flow stores them so): the narrowed types differ by scale
# and have their own keys
CLEAN_SQL = f"""
SELECT CAST(TransactionID AS DOUBLE) AS TransactionID, CAST(TransactionDT AS DOUBLE) AS TransactionDT, TransactionAmt,
       CAST(coalesce(CAST(card1 AS DOUBLE), {_med('card1')}) AS DOUBLE) AS card1, ProductCD,
       CAST(coalesce(CAST(addr1 AS DOUBLE), {_med('addr1')}) AS DOUBLE) AS addr1,
       CAST(coalesce(CAST(addr2 AS DOUBLE), {_med('addr2')}) AS DOUBLE) AS addr2,
       coalesce(P_emaildomain, 'missing') AS P_emaildomain, coalesce(R_emaildomain, 'missing') AS R_emaildomain,
       CAST(isFraud AS DOUBLE) AS isFraud, coalesce(DeviceType, 'missing') AS DeviceType,
       coalesce(DeviceInfo, 'missing') AS DeviceInfo, CAST(transaction_hour AS DOUBLE) AS transaction_hour,
       CAST(transaction_day AS DOUBLE) AS transaction_day, CAST(log_transaction_amt AS DOUBLE) AS log_transaction_amt,
       CAST(coalesce(card1_amount_mean_diff, CAST({_med('card1_amount_mean_diff')} AS FLOAT)) AS DOUBLE) AS card1_amount_mean_diff,
       CAST(coalesce(card1_amount_zscore, CAST({_med('card1_amount_zscore')} AS FLOAT)) AS DOUBLE) AS card1_amount_zscore,
       CAST(product_amount_ratio AS DOUBLE) AS product_amount_ratio, CAST(email_domain_match AS DOUBLE) AS email_domain_match,
       CAST(has_full_address AS DOUBLE) AS has_full_address, CAST(device_info_missing AS DOUBLE) AS device_info_missing,
       CAST(is_mobile_device AS DOUBLE) AS is_mobile_device
FROM feat"""


def _numbers_as_double(df):
    numeric = set(profiling.numeric_columns(df.schema))
    return df.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns])


@query("clean_transactions", _with(CLEAN_SQL, MERGED_CTE, FEAT_CTE))
def q_clean_transactions(spark, sf_dir):
    transactions = fixture(spark, sf_dir, "fx_ieee")
    features = prep.add_ieee_features(_merged(spark, sf_dir), stats_from=transactions)
    cleaned, _ = cleaning.clean_transactions(materialised(features), 0.85)
    return _numbers_as_double(cleaned)


@query("prepared_transactions", _with(CLEAN_SQL, MERGED_CTE, FEAT_CTE))
def q_prepared_transactions(spark, sf_dir):
    return _numbers_as_double(prepare.prepare_transactions(fixture(spark, sf_dir, "fx_ieee"), fixture(spark, sf_dir, "fx_identity"),
                                                           prepare.IEEE_FULL).frame)


SAMPLED_CTE = """sampled AS (SELECT * FROM fx_ieee ORDER BY md5(concat(CAST(TransactionID AS VARCHAR), ':42')), TransactionID LIMIT 10000)"""


@query("prepared_sample", _with(CLEAN_SQL, SAMPLED_CTE, MERGED_CTE.replace("FROM fx_ieee i", "FROM sampled i"), FEAT_CTE))
def q_prepared_sample(spark, sf_dir):
    """E9, the sample preset: its own size, statistics and medians of the sample alone."""
    return _numbers_as_double(prepare.prepare_transactions(fixture(spark, sf_dir, "fx_ieee"), fixture(spark, sf_dir, "fx_identity"),
                                                           prepare.IEEE_SAMPLE).frame)


PROTOTYPE_SQL = f"""SELECT * EXCLUDE (transaction_hour, log_transaction_amt) RENAME ({", ".join(
    f"{prep.FINAL_NAMES[k]} AS {v}" for k, v in prep.PROTOTYPE_NAMES.items())}) FROM ({CLEAN_SQL}) c"""


@query("prepared_prototype", _with(PROTOTYPE_SQL, MERGED_CTE, FEAT_CTE))
def q_prepared_prototype(spark, sf_dir):
    """E9, the prototype flow: its feature names, and neither hour nor log amount."""
    return _numbers_as_double(prepare.prepare_transactions(fixture(spark, sf_dir, "fx_ieee"), fixture(spark, sf_dir, "fx_identity"),
                                                           prepare.IEEE_FULL, prototype=True).frame)


ALL_CATEGORICAL_SQL = ", ".join(f"'{c}'" for c in CATEGORICAL)


@query("cleaning_report", _with(f"""
SELECT (SELECT count(*) FROM feat) AS rows, count(*) FILTER (WHERE ratio <= 0.85) AS columns,
       (SELECT avg(CAST(isFraud AS DOUBLE)) FROM feat) AS label_rate,
       count(*) FILTER (WHERE ratio <= 0.85 AND column_name NOT IN ({ALL_CATEGORICAL_SQL})) AS numeric_columns,
       count(*) FILTER (WHERE ratio <= 0.85 AND column_name IN ({ALL_CATEGORICAL_SQL})) AS categorical_columns,
       0 AS sample_size, 0.85 ::DOUBLE AS missing_threshold, count(*) FILTER (WHERE ratio > 0.85) AS dropped_column_count,
       coalesce(string_agg(column_name, ',') FILTER (WHERE ratio > 0.85), '') AS dropped_columns
FROM ({_null_ratio_union('feat', ALL_FEAT_COLS)}) u""", MERGED_CTE, FEAT_CTE))
def q_cleaning_report(spark, sf_dir):
    p = prepare.prepare_transactions(fixture(spark, sf_dir, "fx_ieee"), fixture(spark, sf_dir, "fx_identity"),
                                     prepare.IEEE_FULL)
    return p.cleaned_profile.select("rows", "columns", "label_rate", "numeric_columns", "categorical_columns",
                                    "sample_size", "missing_threshold", "dropped_column_count",
                                    F.array_join("dropped_columns", ",").alias("dropped_columns"))
