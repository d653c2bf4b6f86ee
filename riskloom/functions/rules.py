"""Risk rule, level, reason and status expressions (L1, L3, L4, D23, A6 formatting).

All are built-in Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason texts, rule weights and thresholds that must equal the reference's.
REASON_VERY_HIGH_AMOUNT = "Very high transaction amount"
REASON_HIGH_AMOUNT = "High transaction amount"
REASON_UNKNOWN_DEVICE = "Unknown device"
REASON_MISSING_ADDRESS = "Missing address"
REASON_MOBILE = "Mobile device usage"
REASON_USER_FREQUENCY = "User has high transaction frequency"
REASON_SHARED_DEVICE = "Device shared across multiple accounts"
REASON_CLUSTER = "Part of suspicious transaction cluster"
REASON_ANOMALY = "Unusual transaction behavior detected"

VERY_HIGH_AMOUNT, VERY_HIGH_POINTS = 5000, 40
HIGH_AMOUNT, HIGH_POINTS = 1000, 25
UNKNOWN_DEVICE_POINTS = 15
MISSING_ADDRESS_POINTS = 10
MOBILE_POINTS = 5
USER_DEGREE_LIMIT, USER_DEGREE_POINTS = 5, 20
DEVICE_USERS_LIMIT, DEVICE_USERS_POINTS = 3, 25
CLUSTER_MIN_NODES, CLUSTER_POINTS = 4, 10          # a cluster is suspicious when size > 4
ANOMALY_REASON_LIMIT = 0.7
WEIGHT_MODEL, WEIGHT_RULES, WEIGHT_ANOMALY, WEIGHT_GRAPH = 0.5, 0.2, 0.15, 0.15
LEVEL_LOW_BELOW, LEVEL_MEDIUM_BELOW = 30, 70


SPLITTER = 134217729.0   # 2**27 + 1, Veltkamp split of a double into two 26-bit halves


def py_round(x: Column, digits: int) -> Column:
    """Python's ``round(x, n)`` on doubles (n <= 4): the decimal value of the binary double is
    rounded half-even. ``x * 10**n`` can round onto a tie (2.675 * 100 = 267.5 exactly, while the
    double 2.675 lies below 2.675), so the product's rounding error is recovered exactly with a
    Veltkamp split and decides ties; exact ties go to even. Spark's ``round`` works on the shortest
    decimal text instead (``round(2.675, 2)`` = 2.68, Python 2.67), see N17."""
    s = float(10 ** digits)
    p = x * F.lit(s)
    t = x * F.lit(SPLITTER)
    hi = t - (t - x)
    lo = x - hi
    err = (hi * F.lit(s) - p) + lo * F.lit(s)
    fl = F.floor(p).cast("double")
    frac = p - fl
    n = (F.when(frac > 0.5, fl + 1).when(frac < 0.5, fl)
         .when(err > 0, fl + 1).when(err < 0, fl).otherwise(F.bround(p, 0)))
    return n / F.lit(s)


def py_round_sql(expr: str, digits: int) -> str:
    """The same rounding as DuckDB SQL text (for oracles)."""
    s = f"{float(10 ** digits)!r}"
    x = f"CAST(({expr}) AS DOUBLE)"
    p = f"({x} * {s})"
    t = f"({x} * {SPLITTER!r})"
    hi = f"({t} - ({t} - {x}))"
    err = f"(({hi} * {s} - {p}) + ({x} - {hi}) * {s})"
    fl = f"CAST(floor({p}) AS DOUBLE)"
    frac = f"({p} - {fl})"
    return (f"((CASE WHEN {frac} > 0.5 THEN {fl} + 1 WHEN {frac} < 0.5 THEN {fl} WHEN {err} > 0 THEN {fl} + 1 "
            f"WHEN {err} < 0 THEN {fl} ELSE round_even({p}, 0) END) / {s})")


def device_key(device: Column) -> Column:
    """A missing device reads as ``unknown``."""
    return F.coalesce(device, F.lit("unknown"))


def amount_or_zero(amount: Column) -> Column:
    return F.coalesce(amount.cast("double"), F.lit(0.0))


def rule_points(amount: Column, device: Column, addr1: Column) -> Column:
    """L1 score: strict thresholds (N12); the address rule tests null only."""
    amt = amount_or_zero(amount)
    dev = device_key(device)
    return (F.when(amt > VERY_HIGH_AMOUNT, VERY_HIGH_POINTS).when(amt > HIGH_AMOUNT, HIGH_POINTS).otherwise(0)
            + F.when(dev == "unknown", UNKNOWN_DEVICE_POINTS).otherwise(0)
            + F.when(addr1.isNull(), MISSING_ADDRESS_POINTS).otherwise(0)
            + F.when(dev == "mobile", MOBILE_POINTS).otherwise(0))


def _ordered(*parts: Column) -> Column:
    """Array of the non-null parts, in the given order."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def rule_reason_parts(amount: Column, device: Column, addr1: Column) -> list[Column]:
    amt = amount_or_zero(amount)
    dev = device_key(device)
    return [
        F.when(amt > VERY_HIGH_AMOUNT, F.lit(REASON_VERY_HIGH_AMOUNT))
         .when(amt > HIGH_AMOUNT, F.lit(REASON_HIGH_AMOUNT)),
        F.when(dev == "unknown", F.lit(REASON_UNKNOWN_DEVICE)),
        F.when(addr1.isNull(), F.lit(REASON_MISSING_ADDRESS)),
        F.when(dev == "mobile", F.lit(REASON_MOBILE)),
    ]


def rule_reasons(amount: Column, device: Column, addr1: Column) -> Column:
    return _ordered(*rule_reason_parts(amount, device, addr1))


def graph_points(user_edges_incl: Column, device_users_incl: Column) -> Column:
    """K5: inclusive counts, strict thresholds."""
    return (F.when(user_edges_incl > USER_DEGREE_LIMIT, USER_DEGREE_POINTS).otherwise(0)
            + F.when(device_users_incl > DEVICE_USERS_LIMIT, DEVICE_USERS_POINTS).otherwise(0))


def graph_reason_parts(user_edges_incl: Column, device_users_incl: Column) -> list[Column]:
    return [F.when(user_edges_incl > USER_DEGREE_LIMIT, F.lit(REASON_USER_FREQUENCY)),
            F.when(device_users_incl > DEVICE_USERS_LIMIT, F.lit(REASON_SHARED_DEVICE))]


def blended_score(probability: Column, rule_score: Column, anomaly: Column, graph_score: Column,
                  in_cluster: Column) -> Column:
    """L2: weighted blend, +10 inside a suspicious cluster, rounded to 2 places."""
    base = (F.lit(WEIGHT_MODEL) * (probability * 100) + F.lit(WEIGHT_RULES) * rule_score
            + F.lit(WEIGHT_ANOMALY) * (anomaly * 100) + F.lit(WEIGHT_GRAPH) * graph_score)
    return py_round(base + F.when(in_cluster, F.lit(CLUSTER_POINTS)).otherwise(0), 2)


def risk_level(score: Column) -> Column:
    """L3 on the rounded score."""
    return (F.when(score < LEVEL_LOW_BELOW, "Low").when(score < LEVEL_MEDIUM_BELOW, "Medium")
            .otherwise("High"))


def all_reasons(amount: Column, device: Column, addr1: Column, user_edges_incl: Column,
                device_users_incl: Column, in_cluster: Column, anomaly: Column) -> Column:
    """L4: rules, graph, cluster, anomaly, in that order."""
    return _ordered(*rule_reason_parts(amount, device, addr1),
                    *graph_reason_parts(user_edges_incl, device_users_incl),
                    F.when(in_cluster, F.lit(REASON_CLUSTER)),
                    F.when(anomaly > ANOMALY_REASON_LIMIT, F.lit(REASON_ANOMALY)))


def reasons_json(reasons: Column) -> Column:
    """The stored text form of a reason list: a JSON array with ``", "`` separators."""
    quoted = F.transform(reasons, lambda r: F.concat(F.lit('"'), r, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def status_from_level(level: Column) -> Column:
    """High -> flagged, medium -> review, anything else -> safe."""
    lv = F.lower(F.coalesce(level, F.lit("")))
    return F.when(lv == "high", "flagged").when(lv == "medium", "review").otherwise("safe")
