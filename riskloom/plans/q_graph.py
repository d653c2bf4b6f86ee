"""Query keys for edges, as-of history, components, clusters and graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import graph, history, sketches
from riskloom.plans.registry import ORACLES, query
from riskloom.session import scratch_path
from riskloom.sources.fixtures import fixture, with_views
from riskloom.sources.tables import materialised, read_edges, table, write_bucketed_edges
from riskloom.streaming.components import GrowingComponents


def txn_edges(spark, sf_dir):
    return history.edge_rows(fixture(spark, sf_dir, "fx_txn"))


EDGES_CTE_SQL = """SELECT TransactionID AS id, ts, 'user_' || coalesce(CAST(card1 AS VARCHAR), 'unknown') AS "user",
       'device_' || coalesce(device, 'unknown') AS device, CAST(coalesce(TransactionAmt, 0) AS DOUBLE) AS amount FROM fx_txn"""


def _txn(sql: str, *extra: str, views=("fx_txn",)) -> str:
    base = with_views("SELECT 1", *views)
    base = base[: base.rfind("\nSELECT 1")]
    return base + f",\nedges AS ({EDGES_CTE_SQL})" + "".join(f",\n{e}" for e in extra) + "\n" + sql


FIRSTS_CTE = """firsts AS (SELECT "user", device, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY "user", device
    ORDER BY ts, id) AS rn FROM edges) f WHERE rn = 1)"""

HIST_CTE = """hist AS (SELECT e.id,
    count(*) OVER (PARTITION BY e."user" ORDER BY e.ts, e.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS user_degree,
    (SELECT count(*) FROM firsts f WHERE f.device = e.device AND (f.ts < e.ts OR (f.ts = e.ts AND f.id < e.id))) AS device_degree,
    (SELECT count(*) FROM firsts f WHERE f.device = e.device AND (f.ts < e.ts OR (f.ts = e.ts AND f.id <= e.id))) AS device_users_incl
  FROM edges e)"""


@query("edge_rows", _txn("SELECT * FROM edges"))
def q_edge_rows(spark, sf_dir):
    return txn_edges(spark, sf_dir)


@query("graph_features_asof", _txn("SELECT id, user_degree, device_degree FROM hist", FIRSTS_CTE, HIST_CTE))
def q_graph_features_asof(spark, sf_dir):
    return history.graph_history(txn_edges(spark, sf_dir)).select("id", "user_degree", "device_degree")


GRAPH_RISK_SQL = """SELECT id,
  (CASE WHEN user_degree + 1 > 5 THEN 20 ELSE 0 END) + (CASE WHEN device_users_incl > 3 THEN 25 ELSE 0 END) AS graph_score,
  '[' || concat_ws(', ', CASE WHEN user_degree + 1 > 5 THEN '"User has high transaction frequency"' END,
                         CASE WHEN device_users_incl > 3 THEN '"Device shared across multiple accounts"' END) || ']' AS reasons_json
FROM hist"""


@query("graph_risk", _txn(GRAPH_RISK_SQL, FIRSTS_CTE, HIST_CTE))
def q_graph_risk(spark, sf_dir):
    h = history.graph_history(txn_edges(spark, sf_dir))
    ue, du = F.col("user_edges_incl"), F.col("device_users_incl")
    reasons = F.filter(F.array(*R.graph_reason_parts(ue, du)), lambda x: x.isNotNull())
    return h.select("id", R.graph_points(ue, du).alias("graph_score"), R.reasons_json(reasons).alias("reasons_json"))


@query("graph_features_snapshot", _txn("""
SELECT e.id, coalesce(u.n, 0) AS user_degree, coalesce(d.n, 0) AS device_degree FROM edges e
LEFT JOIN (SELECT "user", count(*) AS n FROM edges GROUP BY 1) u ON u."user" = e."user"
LEFT JOIN (SELECT device, count(DISTINCT "user") AS n FROM edges GROUP BY 1) d ON d.device = e.device"""))
def q_graph_features_snapshot(spark, sf_dir):
    e = txn_edges(spark, sf_dir)
    snap = history.degree_snapshot(e.select("id", "user", "device"), e)
    return snap.select("id", F.col("g_user_degree").alias("user_degree"), F.col("g_device_degree").alias("device_degree"))


def _bucketed_edges(spark, sf_dir):
    folder = scratch_path(spark, "bucketed")
    return write_bucketed_edges(txn_edges(spark, sf_dir), folder, f"edges_{folder[-12:]}", buckets=16)


@query("degrees_from_buckets", ORACLES["graph_features_snapshot"])
def q_degrees_from_buckets(spark, sf_dir):
    """F2 with the edges stored in buckets of users and of devices."""
    users, devices = (read_edges(spark, name) for name in _bucketed_edges(spark, sf_dir))
    snap = history.degree_snapshot(users.select("id", "user", "device"), users, by_device=devices)
    return snap.select("id", F.col("g_user_degree").alias("user_degree"), F.col("g_device_degree").alias("device_degree"))


@query("user_degree", _txn('SELECT "user", count(*) AS user_degree FROM edges GROUP BY 1'))
def q_user_degree(spark, sf_dir):
    return history.user_degree(txn_edges(spark, sf_dir))


@query("device_degree", _txn('SELECT device, count(DISTINCT "user") AS device_degree FROM edges GROUP BY 1'))
def q_device_degree(spark, sf_dir):
    return history.device_degree(txn_edges(spark, sf_dir))


@query("device_degree_sketch", """
WITH e AS (SELECT l_suppkey AS user_no, o_custkey % 997 AS device_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 997 >= 900 OR l_linenumber = 1 AND l_orderkey % 40 = 0),
d AS (SELECT 'device_' || CAST(device_no AS VARCHAR) AS device, count(DISTINCT user_no) AS n FROM e GROUP BY 1)
SELECT device, n > 3 AS shared, CASE WHEN n <= 3 THEN n ELSE -1 END AS few, true AS close FROM d""")
def q_device_degree_sketch(spark, sf_dir):
    """G10 from sketches stored by month: which devices have more than 3 users, exact counts up to 3, and every other estimate within
    10 percent of the exact count."""
    edges = spark.sql("""SELECT concat('user_', l_suppkey) AS user, concat('device_', o_custkey % 997) AS device, date_trunc('month', o_orderdate) AS day
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey % 997 >= 900 OR l_linenumber = 1 AND l_orderkey % 40 = 0""",
                      lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
    edges = materialised(edges, "edges")
    stored = materialised(sketches.device_sketches(edges), "device-sketches")
    found = sketches.device_degree(stored, edges).join(history.device_degree(edges).withColumnRenamed("device_degree", "n"), "device")
    few = F.when(F.col("exact") & (F.col("device_degree") <= 3), F.col("device_degree")).otherwise(F.lit(-1))
    return found.select("device", (F.col("device_degree") > 3).alias("shared"), few.cast("long").alias("few"),
                        (F.abs(F.col("device_degree") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


# ---------------------------------------------------------------- K1, K2 on fx_edges
def _cc_sql(src: str) -> str:
    return f"""und AS (SELECT "user" AS a, device AS b FROM {src} UNION SELECT device, "user" FROM {src}),
reach(node, r) AS (SELECT a, a FROM und UNION SELECT und.b, reach.r FROM reach JOIN und ON und.a = reach.node),
cc AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"""


def _recursive(sql: str, views: tuple, *ctes: str) -> str:
    base = with_views("SELECT 1", *views)
    base = base[: base.rfind("\nSELECT 1")]
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + "".join(f",\n{c}" for c in ctes) + "\n" + sql


@query("connected_components", _recursive("SELECT node, component FROM cc", ("fx_edges",), _cc_sql("fx_edges")))
def q_connected_components(spark, sf_dir):
    return graph.connected_components(fixture(spark, sf_dir, "fx_edges"))


@query("components_by_batch", _recursive("SELECT node, component FROM cc", ("fx_edges",), _cc_sql("fx_edges")))
def q_components_by_batch(spark, sf_dir):
    """K1 on a growing edge table: the whole of fx_edges arrives in three batches, dealt by a hash of the edge."""
    edges = fixture(spark, sf_dir, "fx_edges").withColumn("part", F.pmod(F.xxhash64("user", "device"), F.lit(3)))
    edges = materialised(edges, "edges")
    growing = GrowingComponents(scratch_path(spark, "components"))
    for batch in range(3):
        growing.add(edges.where(F.col("part") == batch), batch)
    return growing.labels(spark, 3)


CLUSTERS_SQL = """SELECT 'Cluster-' || CAST(n AS VARCHAR) AS cluster_id, size,
       CASE WHEN size >= 6 THEN 'high' ELSE 'medium' END AS risk, cc.node
FROM cc JOIN (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS n
              FROM (SELECT component, count(*) AS size FROM cc GROUP BY 1) s WHERE size > 4) k USING (component)"""


@query("fraud_clusters", _recursive(CLUSTERS_SQL, ("fx_edges",), _cc_sql("fx_edges")))
def q_fraud_clusters(spark, sf_dir):
    return graph.fraud_clusters(graph.connected_components(fixture(spark, sf_dir, "fx_edges")))


# ---------------------------------------------------------------- K6, F3 on fx_edge_log
ASOF_REACH = """lfirst AS (SELECT "user", device, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY "user", device
    ORDER BY ts, id) AS rn FROM fx_edge_log) f WHERE rn = 1),
reach(rid, rts, node) AS (
  SELECT id, ts, "user" FROM fx_edge_log
  UNION
  SELECT r.rid, r.rts, CASE WHEN f."user" = r.node THEN f.device ELSE f."user" END
  FROM reach r JOIN lfirst f ON (f."user" = r.node OR f.device = r.node)
  WHERE f.ts < r.rts OR (f.ts = r.rts AND f.id <= r.rid))"""


@query("cluster_flag_asof", _recursive("SELECT rid AS id, count(*) > 4 AS in_cluster FROM reach GROUP BY rid",
                                       ("fx_edge_log",), ASOF_REACH))
def q_cluster_flag_asof(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx_edge_log")
    return graph.cluster_flag_asof(log).select("id", "in_cluster")


@query("cluster_membership", _recursive("""
SELECT l.id, coalesce(s.size > 4, false) AS in_cluster FROM fx_edge_log l
LEFT JOIN cc ON cc.node = l."user" LEFT JOIN (SELECT component, count(*) AS size FROM cc GROUP BY 1) s USING (component)""",
                                        ("fx_edge_log",), _cc_sql("fx_edge_log")))
def q_cluster_membership(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx_edge_log")
    clusters = graph.fraud_clusters(graph.connected_components(log))
    return graph.cluster_membership(log, clusters).select("id", "in_cluster")


# ---------------------------------------------------------------- K7-K10 graph view
NODES_CTE = """flagged AS (SELECT DISTINCT card1, device FROM fx_pred WHERE lower(risk_level) = 'high'),
fids AS (SELECT 'user_' || CAST(card1 AS VARCHAR) AS id FROM flagged WHERE card1 IS NOT NULL
         UNION SELECT 'device_' || device FROM flagged WHERE device IS NOT NULL AND device <> ''),
nodes AS (SELECT id, label, type, id IN (SELECT id FROM fids) AS fraud FROM (
   SELECT DISTINCT "user" AS id, replace("user", 'user_', 'Card ') AS label, 'user' AS type FROM edges
   UNION ALL
   SELECT DISTINCT device, 'Device ' || upper(substr(device, 8, 1)) || lower(substr(device, 9)), 'device' FROM edges) n)"""


def _pred_graph(spark, sf_dir):
    return txn_edges(spark, sf_dir), fixture(spark, sf_dir, "fx_pred")


@query("graph_nodes", _txn("SELECT * FROM nodes", NODES_CTE, views=("fx_txn", "fx_pred")))
def q_graph_nodes(spark, sf_dir):
    e, p = _pred_graph(spark, sf_dir)
    return graph.graph_nodes(e, p)


@query("graph_links", _txn("""
SELECT l.source, l.target, coalesce(s.fraud, false) OR coalesce(t.fraud, false) AS flagged
FROM (SELECT DISTINCT "user" AS source, device AS target FROM edges) l
LEFT JOIN nodes s ON s.id = l.source LEFT JOIN nodes t ON t.id = l.target""", NODES_CTE, views=("fx_txn", "fx_pred")))
def q_graph_links(spark, sf_dir):
    e, p = _pred_graph(spark, sf_dir)
    return graph.graph_links(e, graph.graph_nodes(e, p))


@query("graph_stats", _recursive("""
SELECT 'Total Nodes' AS label, (SELECT count(*) FROM (SELECT "user" FROM edges UNION SELECT device FROM edges) x) AS value
UNION ALL SELECT 'Total Edges', (SELECT count(*) FROM (SELECT DISTINCT "user", device FROM edges) x)
UNION ALL SELECT 'Flagged Nodes', (SELECT count(*) FROM fx_pred WHERE lower(risk_level) = 'high')
UNION ALL SELECT 'Clusters', (SELECT count(*) FROM (SELECT component FROM cc GROUP BY 1 HAVING count(*) > 4) x)""",
                                 ("fx_txn", "fx_pred"), f"edges AS ({EDGES_CTE_SQL})", _cc_sql("edges")))
def q_graph_stats(spark, sf_dir):
    e, p = _pred_graph(spark, sf_dir)
    return graph.graph_stats(e, p, graph.connected_components(e))
