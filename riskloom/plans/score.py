"""The scoring plan (L5): one DataFrame of transactions in, one of scored rows out.

Per-row order of the reference, kept through row order instead of per-request state (N10):
features with the history *before* the row -> model probability and anomaly -> the row's edge is
stored -> rules, graph risk and clusters with the history *including* the row -> blend, level,
reasons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import graph, history, prep, scoring
from riskloom.sources.tables import materialised

ScoreFn = Callable[[DataFrame], DataFrame]


def with_history(txn: DataFrame, id_col: str = "TransactionID", history_edges: DataFrame | None = None,
                 card: str = "card1", device: str = "device", state: history.GraphState | None = None,
                 cluster_times: Callable[[DataFrame], DataFrame] = graph.cluster_times, links: DataFrame | None = None) -> DataFrame:
    """Attach as-of graph counts and the as-of cluster flag to every transaction, carrying the
    transaction's columns through (no join back by id). Earlier history (streams) comes either as
    raw ``history_edges`` (id, ts, user, device) or as ``state``, then with ``cluster_times`` that know
    the stored clusters; it counts but is not returned. ``links``: the stored ``graph.edge_links`` of ``txn``, which then
    is a stored table itself: its rows aren't written again, nor searched for the first of each link."""
    rows = txn.select("*", F.col(id_col).alias("id"),
                      F.concat(F.lit("user_"), F.coalesce(F.col(card).cast("string"), F.lit("unknown"))).alias("user"),
                      F.concat(F.lit("device_"), F.coalesce(F.col(device), F.lit("unknown"))).alias("_device_key"),
                      F.lit(False).alias("_prior"))
    rows = rows.withColumnRenamed(device, "_device_raw") if device == "device" else rows
    rows = rows.withColumnRenamed("_device_key", "device")
    if history_edges is not None:
        prior = history_edges.select("id", "ts", "user", "device").withColumn("_prior", F.lit(True))
        rows = rows.unionByName(prior, allowMissingColumns=True)
    if links is None:
        rows = materialised(rows, "scoring-rows")      # clusters, cut points, first rows and sums all read it
    times = cluster_times(rows.select("id", "ts", "user", "device"))
    firsts = None if links is None else links.select("device", "user", "first.ts", "first.id")
    hist = history.graph_history(rows, prior=state, materialise=False, firsts=firsts)
    flagged = graph.flag_from_times(hist, times)
    out = flagged.where(~F.col("_prior")).drop("_prior", "id", "user", "device")
    return out.withColumnRenamed("_device_raw", device) if device == "device" else out


def score(txn: DataFrame, probability: ScoreFn, anomaly: ScoreFn, id_col: str = "TransactionID",
          history_edges: DataFrame | None = None, state: history.GraphState | None = None,
          cluster_times: Callable[[DataFrame], DataFrame] = graph.cluster_times, links: DataFrame | None = None) -> DataFrame:
    """L5. ``probability`` / ``anomaly`` add ``fraud_probability`` / ``anomaly_score`` to a frame of
    aligned features (fitted models from ``riskloom.operators.models``, or any column rule)."""
    h = with_history(txn, id_col, history_edges, state=state, cluster_times=cluster_times, links=links)
    feats = prep.scoring_features(h).withColumn("g_user_degree", F.col("user_degree")) \
                                    .withColumn("g_device_degree", F.col("device_degree"))
    scored = anomaly(probability(feats))
    ruled = scoring.rule_score(scored)
    graphed = ruled.withColumn("graph_score", R.graph_points(F.col("user_edges_incl"), F.col("device_users_incl")))
    blended = scoring.blend(graphed)
    out = scoring.reasons(blended)
    return out.withColumn("fraud_probability", R.py_round(F.col("fraud_probability"), 4))


def scored_view(scored: DataFrame, id_col: str = "TransactionID") -> DataFrame:
    """The result columns of a scored transaction."""
    return scored.select(F.col(id_col).alias("transaction_id"), "fraud_probability", "anomaly_score", "risk_score",
                         "risk_level", "reasons", R.reasons_json(F.col("reasons")).alias("reasons_json"))
