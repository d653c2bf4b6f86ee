"""Test-input views over the generated tables.

The same SQL text feeds Spark (through DataFrame parameters of ``spark.sql``, so no global view
names) and the DuckDB oracle (table names substituted). Only the ``datediff`` unit differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.tables import table

# The view definitions of the test inputs, as given with the test data.
FIXTURE_SQL = {
    "fx_txn": """
SELECT event_id AS TransactionID, ts, value * 20 AS TransactionAmt, user_id AS card1,
       CASE event_type WHEN 'click' THEN 'mobile' WHEN 'error' THEN 'unknown'
                       WHEN 'signup' THEN 'tablet' ELSE 'desktop' END AS device,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0
            ELSE CAST(100 + user_id % 900 AS INT) END AS addr1
FROM {events}
""",
    "fx_ieee": """
SELECT o_orderkey AS TransactionID,
       datediff({day_unit}, TIMESTAMP '1995-01-01 00:00:00', o_orderdate) * 86400 + (o_orderkey * 977) % 86400 AS TransactionDT,
       o_totalprice AS TransactionAmt,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS card1,
       o_orderpriority AS ProductCD,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 500 AS INT) END AS addr1,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS INT) END AS addr2,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('mail', CAST(o_custkey % 4 AS VARCHAR(8)), '.com') END AS P_emaildomain,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('mail', CAST(o_orderkey % 4 AS VARCHAR(8)), '.com') END AS R_emaildomain,
       CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey % 77 AS DOUBLE) ELSE NULL END AS dist1,
       CASE WHEN o_orderkey % 29 = 3 THEN 1 ELSE 0 END AS isFraud
FROM {orders}
""",
    "fx_identity": """
SELECT o_orderkey AS TransactionID,
       CASE WHEN o_custkey % 3 = 0 THEN 'Mobile' WHEN o_custkey % 3 = 1 THEN 'desktop' END AS DeviceType,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'Windows' ELSE concat('dev', CAST(o_custkey % 300 AS VARCHAR(8))) END AS DeviceInfo
FROM {orders} WHERE o_orderkey % 2 = 0
""",
    "fx_pay": """
SELECT CAST(year(o_orderdate) - 1995 AS INT) * 12 + CAST(month(o_orderdate) AS INT) AS step,
       CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'CASH_OUT'
            WHEN l_returnflag = 'A' THEN 'TRANSFER' ELSE 'PAYMENT' END AS type,
       l_extendedprice AS amount,
       concat('C', CAST(o_custkey AS VARCHAR(20))) AS nameOrig,
       c_acctbal AS oldbalanceOrg, c_acctbal - l_extendedprice AS newbalanceOrig,
       concat('S', CAST(l_suppkey AS VARCHAR(20))) AS nameDest,
       s_acctbal AS oldbalanceDest, s_acctbal + l_extendedprice AS newbalanceDest,
       CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 1 ELSE 0 END AS isFraud,
       CASE WHEN l_extendedprice > 90000 THEN 1 ELSE 0 END AS isFlaggedFraud
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {supplier} ON l_suppkey = s_suppkey
""",
    "fx_edges": """
SELECT DISTINCT concat('user_', CAST(o_orderkey AS VARCHAR(20))) AS user,
       concat('device_', CAST(floor(o_orderkey / 5) AS BIGINT), '_', CAST(l_suppkey % 4 AS VARCHAR(8))) AS device
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""",
    "fx_edge_log": """
SELECT o_orderdate AS ts, o_orderkey AS id,
       concat('user_', CAST(floor(o_orderkey / 12) AS BIGINT), '_', CAST(min(o_custkey) % 4 AS VARCHAR(8))) AS user,
       concat('device_', CAST(floor(o_orderkey / 12) AS BIGINT), '_', CAST(min(l_partkey) % 5 AS VARCHAR(8))) AS device
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_orderdate, o_orderkey
""",
    "fx_pred": """
SELECT event_id AS transaction_id, ts AS created_at, value * 20 AS amount, user_id AS card1,
       CASE event_type WHEN 'click' THEN 'mobile' WHEN 'error' THEN 'unknown'
                       WHEN 'signup' THEN 'tablet' ELSE 'desktop' END AS device,
       CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 AS fraud_probability,
       0.4 + CAST(event_id % 13 AS DOUBLE) * 0.0625 AS anomaly_score,
       CAST((event_id * 37) % 1000 AS DOUBLE) / 10 AS risk_score,
       CASE WHEN (event_id * 37) % 1000 < 300 THEN 'Low' WHEN (event_id * 37) % 1000 < 700 THEN 'Medium'
            ELSE 'High' END AS risk_level,
       CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 700 END AS addr1,
       CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["High amount"]' WHEN 2 THEN '["High amount", "New device"]'
                         ELSE '["High amount", "New device", "Odd hour"]' END AS reasons_json,
       CASE WHEN (event_id * 37) % 1000 + (event_id * 53) % 500 > 1200 THEN 1 ELSE 0 END AS isFraud
FROM {events}
""",
}

# fx_pay with a key column for the preset that samples.
FIXTURE_SQL["fx_pay_keyed"] = FIXTURE_SQL["fx_pay"].replace("SELECT ", """SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-',
       CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS _row_key,
       """, 1)

# Rows whose label follows from their features, for models to learn.
FIXTURE_SQL["fx_learn"] = """
SELECT l_orderkey * 8 + l_linenumber AS TransactionID, CAST(l_quantity AS DOUBLE) AS quantity,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS discount,
       CAST(l_tax AS DOUBLE) AS tax, CAST(l_linenumber AS DOUBLE) AS line,
       CASE WHEN l_quantity * 2 + l_discount * 300 + CASE WHEN l_partkey % 7 = 0 THEN 25 ELSE 0 END
                 + (l_orderkey * 37 + l_linenumber * 11) % 60 > 120 THEN 1 ELSE 0 END AS isFraud
FROM {lineitem}
"""

# Fixed value: the report clock used with fx_pred.
ASOF = "2024-01-30 12:00:00"

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _tables_of(sql: str) -> list[str]:
    return sorted({m for m in _PLACEHOLDER.findall(sql) if m != "day_unit"})


def duckdb_sql(name: str) -> str:
    """The view as DuckDB text (tables referenced by their registered names)."""
    sql = FIXTURE_SQL[name]
    subs = {t: t for t in _tables_of(sql)}
    subs["day_unit"] = "'day'"
    return sql.format(**subs).strip()


def with_views(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the fixture views it uses, as CTEs."""
    ctes = ",\n".join(f"{n} AS ({duckdb_sql(n)})" for n in names)
    return f"WITH {ctes}\n{sql}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a Spark DataFrame over the parquet tables in ``sf_dir``."""
    # the views are defined on UTC wall-clock times (parquet timestamps carry no zone)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = FIXTURE_SQL[name]
    kwargs = {t: table(spark, sf_dir, t) for t in _tables_of(sql)}
    text = sql.replace("{day_unit}", "DAY")
    df = spark.sql(text, **kwargs)
    # parquet timestamps arrive as timestamp_ntz; the operators work on UTC timestamps
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, df[f.name].cast("timestamp"))
    return df
