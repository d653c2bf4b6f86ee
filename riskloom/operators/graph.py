"""Account graph operators.

Components use local contractions (Lacki, Mirrokni and Wlodarczyk, 2018): in every round each node is merged into the
neighbour that comes first in a random order, and the next round runs on the edges between what is left. A round is a grouped
min plus two equi-joins over the edges still there, so nothing is collected per component and a hot node is a skewed join key
that AQE splits. Each round is written once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir
from riskloom.sources.tables import materialised

LONG_MIN = -(1 << 63)
CLUSTER_NODES = 5       # a suspicious cluster has at least so many nodes
TASK_EDGES, ONE_TASK = 200_000, 500_000     # edges of whole components that a task takes; a component of more goes by rounds


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges stored once as (hi, lo) with hi > lo; loops and nulls dropped."""
    return (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())


def _hashed_nodes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` and nodes ``(nid, node)`` under 64-bit hashes: of whole numbers xxhash64 is one to one; of names it is
    checked, and drawn anew with another salt if two names meet."""
    whole, salt = named.schema["hi"].dataType.typeName() in ("byte", "short", "integer", "long"), 0
    while True:
        key = (lambda c: F.xxhash64(F.col(c).cast("long"))) if whole else (lambda c: F.xxhash64(F.lit(salt), c))
        stored = materialised(named.select("hi", "lo", key("hi").alias("a"), key("lo").alias("b")), "named-edges")
        nodes = materialised(stored.select(F.col("a").alias("nid"), F.col("hi").alias("node"))
                             .union(stored.select("b", "lo")).distinct(), "named-nodes")
        if whole or nodes.groupBy("nid").count().where("count > 1").isEmpty():
            return stored.select("a", "b"), nodes
        salt += 1


def connected_components(edges: DataFrame, src: str = "user", dst: str = "device") -> DataFrame:
    """K1: ``(node, component)`` for every node of the undirected graph; ``component`` is the
    smallest node id of the component. The rounds run on hashes of the nodes, and what a round leaves is hashed again (one to one), so
    that each has an order of its own and edges shrink by a constant share in expectation; rounds go on until no edge
    is left, however many that takes. The groups are then followed down through the rounds and named by their smallest node."""
    e, nodes = _hashed_nodes(_oriented(edges, src, dst))
    rounds = []
    while True:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).union(e.select("b", "a"))
        # what a node is merged into, in the numbers of the next round
        to = materialised(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.xxhash64(F.least("v", "w")).alias("to")), "merged-nodes")
        rounds.append(to)
        left = (e.join(to.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
                .join(to.select(F.col("v").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        e = materialised(left, "edges-left")
        if e.isEmpty():
            break
    label, above = rounds.pop().withColumnRenamed("to", "label"), 0
    while rounds:
        above += 1
        done = F.col("to")                                           # nodes without further edges: only hashed on
        for _ in range(above):
            done = F.xxhash64(done)
        label = (rounds.pop().join(label.withColumnRenamed("v", "to"), "to", "left")
                 .select("v", F.coalesce("label", done).alias("label")))
    labelled = materialised(nodes.join(label.withColumnRenamed("v", "nid"), "nid").select("node", "label"), "labelled-nodes")
    return labelled.join(labelled.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")


def number_rows(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Dense 1-based numbering in a global order without a single-partition window and without
    leaving the JVM: a distributed sort, ``monotonically_increasing_id`` inside each sorted
    partition, and a prefix over the per-partition row counts (one small row per partition). The
    sorted, tagged rows are checkpointed so every later use sees the same numbering."""
    checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + local + 1).cast("long")).drop("_mid", "_pid", "_off"))


def fraud_clusters(components: DataFrame, min_size: int = 5) -> DataFrame:
    """K2 in long form: one row per node of a component with more than ``min_size - 1`` nodes:
    ``cluster_id`` (``Cluster-<n>``, numbered by size desc then smallest node), ``size``,
    ``risk`` (``high`` when size >= 6 else ``medium``), ``node``. No node list is collected."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    numbered = number_rows(sizes, [F.desc("size"), F.asc("component")], "n")
    clusters = numbered.select("component", "size", F.concat(F.lit("Cluster-"), F.col("n")).alias("cluster_id"),
                               F.when(F.col("size") >= 6, "high").otherwise("medium").alias("risk"))
    return components.join(clusters, "component").select("cluster_id", "size", "risk", "node")


def cluster_membership(rows: DataFrame, clusters: DataFrame, user: str = "user") -> DataFrame:
    """``in_cluster`` - the row's user is a node of a suspicious cluster (left semi as a join
    against distinct member nodes)."""
    members = clusters.select(F.col("node").alias("_member")).distinct().withColumn("_hit", F.lit(True))
    return (rows.join(members, rows[user] == members["_member"], "left")
                .withColumn("in_cluster", F.coalesce(F.col("_hit"), F.lit(False))).drop("_member", "_hit"))


def _order_key(ts: str, id_col: str):
    return F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(id_col).cast("long").alias("i"))


def _relaxed(adj: DataFrame, lists: DataFrame, hops: int, k: int, final: DataFrame | None = None) -> DataFrame:
    """``hops`` rounds over ``adj`` (v, w, t; with a self-loop per node) on the lists ``(v, lst)`` of the ``k`` earliest
    ``(b, x)`` per node. ``final``: lists of further nodes, which give their entries in every round and take none."""
    w = Window.partitionBy("v").orderBy("b", "x")
    for r in range(hops):
        giving = lists if final is None else lists.unionByName(final)
        lifted = (adj.join(giving.withColumnRenamed("v", "w"), "w").select("v", "t", F.explode("lst").alias("e"))
                  .select("v", F.col("e.x").alias("x"), F.greatest(F.col("t"), F.col("e.b")).alias("b")))
        best = lifted.groupBy("v", "x").agg(F.min("b").alias("b"))
        top = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        lists = top.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("b", "x"))).alias("lst"))
        if r % 2 == 1 or r == hops - 1:
            lists = materialised(lists, "cluster-rounds")
    return lists


def _merge_times(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of whole components' edges ``(user, device, t, i)``: the order key at which each node's group first has ``k`` nodes, merging along
    the edges in their order (the smaller group into the larger)."""
    codes, names = pd.factorize(pd.concat([pdf["user"], pdf["device"]], ignore_index=True))
    users, devices = codes[:len(pdf)].tolist(), codes[len(pdf):].tolist()
    group, members, at = list(range(len(names))), [[c] for c in range(len(names))], np.full(len(names), -1)
    for e in np.lexsort((pdf["i"].to_numpy(), pdf["t"].to_numpy())).tolist():
        one, two = sorted((group[users[e]], group[devices[e]]), key=lambda g: len(members[g]))
        if one == two:
            continue
        if len(members[one]) + len(members[two]) >= k:
            for g in (one, two):
                if len(members[g]) < k:
                    at[members[g]] = e
        for c in members[one]:
            group[c] = two
        members[two] += members[one]
        members[one] = []
    timed = at >= 0
    return pd.DataFrame({"user": np.asarray(names, object)[timed], "t": pdf["t"].to_numpy()[at[timed]], "i": pdf["i"].to_numpy()[at[timed]]})


def cluster_times(edges: DataFrame, hops: int = CLUSTER_NODES - 1, k: int = CLUSTER_NODES, one_task: int = ONE_TASK) -> DataFrame:
    """K6 core: ``(user, _tstar)`` = the order key ``(t, i)`` at which the user's component first
    has at least ``k`` nodes (absent when it never does).

    Whole components are dealt into tasks by a hash, and each task merges their edges in order. A component of more than
    ``one_task`` edges is no task's: its nodes go by the rounds of ``times_by_rounds``, with the same result. Edges without a time come
    first, all at once."""
    checkpoint_dir(edges.sparkSession)
    named = materialised(edges.where(F.col("user").isNotNull() & F.col("device").isNotNull())
                         .groupBy("user", "device").agg(F.min(_order_key("ts", "id")).alias("t")), "first-edges")
    components = connected_components(named).select(F.col("node").alias("user"), "component")
    placed = materialised(named.join(components, "user"), "placed-edges")
    sizes = placed.groupBy("component").count()
    large = sizes.where(F.col("count") > one_task).select("component")
    rest, big = placed, None
    if not large.isEmpty():
        large = materialised(large, "large-components")
        rest, big = placed.join(large, "component", "left_anti"), placed.join(large, "component", "left_semi")
    tasks = max(1, -(-rest.count() // TASK_EDGES))
    none = F.col("t.t").isNull()
    flat = rest.select("user", "device", F.coalesce("t.t", F.lit(LONG_MIN)).alias("t"),
                       F.when(none, F.lit(LONG_MIN)).otherwise(F.coalesce("t.i", F.lit(LONG_MIN))).alias("i"),
                       F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"))
    kind = named.schema["user"].dataType.simpleString()
    merged = flat.groupBy("task").applyInPandas(lambda pdf: _merge_times(pdf, k), f"user {kind}, t long, i long")
    no_id = (F.col("i") == LONG_MIN) & (F.col("t") > LONG_MIN)
    times = merged.select("user", F.struct("t", F.when(~no_id, F.col("i")).alias("i")).alias("_tstar"))
    if big is None:
        return times
    return times.unionByName(times_by_rounds(big.select("user", "device", "t"), hops, k))


def times_by_rounds(named: DataFrame, hops: int = CLUSTER_NODES - 1, k: int = CLUSTER_NODES) -> DataFrame:
    """``cluster_times`` of edges ``(user, device, t)`` by rounds over the adjacency, nothing of a component in one place.

    A component has >= k nodes iff k nodes lie within k-1 hops of the user. Each node keeps the k
    nodes with the smallest bottleneck time (the earliest time a path of <= h hops exists). A round
    joins the lists to the adjacency (plus a self-loop per node at time -inf, which carries a node's
    own entries), lifts entries by the edge time, keeps the minimum per (node, entry) and the k
    smallest per node (``row_number() <= k`` is limited on the map side before the shuffle, so a
    hub node ships at most k rows per partition)."""
    checkpoint_dir(named.sparkSession)
    # node names -> dense long ids once; the rounds shuffle longs (any consistent order of ids works)
    nodes = named.select(F.col("user").alias("node")).union(named.select(F.col("device").alias("node"))).distinct()
    ids = number_rows(nodes, [F.col("node")], "nid")
    pairs = (named.join(ids.select(F.col("node").alias("user"), F.col("nid").alias("u")), "user")
             .join(ids.select(F.col("node").alias("device"), F.col("nid").alias("d")), "device")
             .select(F.col("u").alias("user"), F.col("d").alias("device"), "t"))
    sentinel = F.struct(F.lit(LONG_MIN).alias("t"), F.lit(LONG_MIN).alias("i"))
    adj = (pairs.select(F.col("user").alias("v"), F.col("device").alias("w"), "t")
           .unionByName(pairs.select(F.col("device").alias("v"), F.col("user").alias("w"), "t")))
    nodes = adj.select("v").distinct()
    adj = adj.unionByName(nodes.select("v", F.col("v").alias("w"), sentinel.alias("t"))).checkpoint()
    lists = _relaxed(adj, nodes.select("v", F.array(F.struct(sentinel.alias("b"), F.col("v").alias("x"))).alias("lst")), hops, k)
    times = lists.where(F.size("lst") >= k).select(F.col("v").alias("nid"), F.element_at("lst", k)["b"].alias("_tstar"))
    return times.join(ids, "nid").select(F.col("node").alias("user"), "_tstar")


LISTS_SCHEMA = "node string, lst array<struct<b: struct<t: bigint, i: bigint>, x: string>>"


def edge_links(edges: DataFrame) -> DataFrame:
    """The links of edge rows (id, ts, user, device): per user and device the number of rows ``n``, the first order key ``t``, the
    ``first`` (ts, id) and the newest time ``last``. What a stream batch asks of its edges, but for the counts as of each row, is read off these."""
    return edges.groupBy("user", "device").agg(F.count(F.lit(1)).alias("n"), F.min(_order_key("ts", "id")).alias("t"),
                                               F.min(F.struct("ts", "id")).alias("first"), F.max("ts").alias("last"))


def grown_cluster_lists(edges: DataFrame, stored: Callable[[DataFrame], DataFrame], hops: int = CLUSTER_NODES - 1, k: int = CLUSTER_NODES) -> DataFrame:
    """``grown_lists`` of edge rows (id, ts, user, device): ``(node, lst)``."""
    return grown_lists(materialised(edge_links(edges), "links"), stored, hops, k).select("node", "lst")


def grown_lists(links: DataFrame, stored: Callable[[DataFrame], DataFrame], hops: int = CLUSTER_NODES - 1, k: int = CLUSTER_NODES) -> DataFrame:
    """K6 by increments: the earliest-``k`` lists ``(node, lst, changed)`` of the nodes that new ``links`` (user, device, t; a stored table, all
    later than what is stored) touch, and of those whose component they extend. ``stored`` looks lists up by node; ``changed``: the
    list is not the stored one.

    A full list is final: whatever comes has a later time. A list that is not full holds its whole component, so
    the component of a touched node is read off its list, and the members' lists are all that can change besides. The
    rounds therefore run over the new links and the small components they touch, for the nodes whose lists are not full alone; the full
    lists that these meet give their entries and take none, and the other full lists are passed on as they are."""
    new = (links.select(F.col("user").alias("v"), F.col("device").alias("w"), "t")
           .unionByName(links.select(F.col("device").alias("v"), F.col("user").alias("w"), "t")))
    touched = new.select(F.col("v").alias("node")).distinct()
    known = materialised(stored(touched), "known-lists")
    small = known.where(F.size("lst") < k)
    nodes, adj = touched, new
    if not small.isEmpty():
        inner = (small.select(F.col("node").alias("v"), F.explode("lst").alias("e")).where(F.col("e.x") != F.col("v"))
                 .select("v", F.col("e.x").alias("w"), F.col("e.b").alias("t")))
        members = inner.select(F.col("w").alias("node")).distinct().join(touched, "node", "left_anti")
        known = known.unionByName(materialised(stored(members), "known-members"))
        nodes = touched.unionByName(members)
        adj = new.unionByName(inner).unionByName(inner.select(F.col("w").alias("v"), F.col("v").alias("w"), "t"))
    full = known.where(F.size("lst") >= k)
    sentinel = F.struct(F.lit(LONG_MIN).alias("t"), F.lit(LONG_MIN).alias("i"))
    own = F.array(F.struct(sentinel.alias("b"), F.col("node").alias("x")))
    open_lists = materialised(nodes.join(full, "node", "left_anti").join(known.withColumnRenamed("lst", "old"), "node", "left")
                              .select("node", F.coalesce("old", own).alias("lst"), "old"), "open-lists")
    done = full.select("node", "lst", F.lit(False).alias("changed"))
    if open_lists.isEmpty():
        return done
    start = open_lists.select(F.col("node").alias("v"), "lst")
    # self-loops carry every node's own entries
    adj = materialised(adj.join(start.select("v"), "v", "left_semi")
                       .unionByName(start.select("v", F.col("v").alias("w"), sentinel.alias("t"))), "open-links")
    met = materialised(full.withColumnRenamed("node", "v").join(adj.select(F.col("w").alias("v")).distinct(), "v", "left_semi"), "met-lists")
    grown = (_relaxed(adj, start, hops, k, final=met).withColumnRenamed("v", "node").join(open_lists.select("node", "old"), "node")
             .select("node", "lst", (F.col("old").isNull() | (F.col("old") != F.col("lst"))).alias("changed")))
    return done.unionByName(grown)


def flag_from_times(rows: DataFrame, times: DataFrame, out: str = "in_cluster") -> DataFrame:
    """K6 flag: the row's order key is at or after its user's cluster time."""
    t = times.withColumnRenamed("user", "_u")
    j = rows.join(t, rows["user"] == t["_u"], "left")
    return j.withColumn(out, F.coalesce(_order_key("ts", "id") >= F.col("_tstar"), F.lit(False))).drop("_u", "_tstar")


def cluster_flag_asof(edges: DataFrame, hops: int = CLUSTER_NODES - 1, k: int = CLUSTER_NODES) -> DataFrame:
    """K6: ``in_cluster`` for every edge row ``(id, ts, user, device)``: with all edges up to and
    including this row, the user's component has more than 4 nodes."""
    return flag_from_times(edges, cluster_times(edges.select("id", "ts", "user", "device"), hops, k))


def title_case(text: Column) -> Column:
    """Every letter that follows a non-letter in upper case, every other one in lower case."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def graph_nodes(edges: DataFrame, predictions: DataFrame) -> DataFrame:
    """K7 + F4: distinct users and devices with label, type and fraud flag. A node is flagged when
    its user or device appears in a high-risk prediction (J3: distinct flagged keys)."""
    flagged = (predictions.where(F.lower(F.col("risk_level")) == "high").select("card1", "device").distinct())
    f_users = (flagged.where(F.col("card1").isNotNull())
               .select(F.concat(F.lit("user_"), F.col("card1").cast("string")).alias("id")).distinct())
    f_devs = (flagged.where(F.col("device").isNotNull() & (F.col("device") != ""))
              .select(F.concat(F.lit("device_"), F.col("device")).alias("id")).distinct())
    flagged_ids = f_users.unionByName(f_devs).distinct().withColumn("fraud", F.lit(True))
    users = edges.select(F.col("user").alias("id")).distinct().select(
        "id", F.replace(F.col("id"), F.lit("user_"), F.lit("Card ")).alias("label"), F.lit("user").alias("type"))
    devs = edges.select(F.col("device").alias("id")).distinct().select(
        "id", title_case(F.replace(F.col("id"), F.lit("device_"), F.lit("Device "))).alias("label"),
        F.lit("device").alias("type"))
    nodes = users.unionByName(devs)
    return (nodes.join(flagged_ids, "id", "left")
            .select("id", "label", "type", F.coalesce(F.col("fraud"), F.lit(False)).alias("fraud")))


def graph_links(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """K8 (J2) and K10: distinct user -> device links; ``flagged`` when either end is flagged."""
    links = edges.select(F.col("user").alias("source"), F.col("device").alias("target")).distinct()
    if nodes is None:
        return links
    fl = nodes.where(F.col("fraud")).select("id")
    s = fl.select(F.col("id").alias("_s"), F.lit(True).alias("_sf"))
    t = fl.select(F.col("id").alias("_t"), F.lit(True).alias("_tf"))
    return (links.join(s, links["source"] == s["_s"], "left").join(t, links["target"] == t["_t"], "left")
            .select("source", "target", (F.coalesce(F.col("_sf"), F.lit(False)) | F.coalesce(F.col("_tf"), F.lit(False)))
                    .alias("flagged")))


def graph_stats(edges: DataFrame, predictions: DataFrame, components: DataFrame, min_size: int = 5) -> DataFrame:
    """K9 in long form (label, value): nodes, distinct links, high-risk predictions (the reference
    shows them as "Flagged Nodes") and suspicious clusters. Four one-row aggregates."""
    n_nodes = (edges.select(F.col("user").alias("n")).union(edges.select(F.col("device").alias("n"))).distinct()
               .agg(F.count(F.lit(1)).alias("v")).select(F.lit("Total Nodes").alias("label"), "v"))
    n_links = (edges.select("user", "device").distinct().agg(F.count(F.lit(1)).alias("v"))
               .select(F.lit("Total Edges").alias("label"), "v"))
    n_high = (predictions.agg(F.count_if(F.lower(F.col("risk_level")) == "high").alias("v"))
              .select(F.lit("Flagged Nodes").alias("label"), "v"))
    n_clusters = (components.groupBy("component").count().where(F.col("count") >= min_size)
                  .agg(F.count(F.lit(1)).alias("v")).select(F.lit("Clusters").alias("label"), "v"))
    return n_nodes.unionByName(n_links).unionByName(n_high).unionByName(n_clusters) \
                  .select("label", F.col("v").cast("long").alias("value"))
