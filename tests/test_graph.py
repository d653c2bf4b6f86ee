"""As-of history and components against brute force."""

import datetime as dt
import random

from riskloom.operators import graph, history

T0 = dt.datetime(2024, 1, 1)


def _log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), u, d) for i, m, u, d in rows],
                                 "id long, ts timestamp, user string, device string")


def _brute_history(rows):
    out = {}
    seen = []
    for i, m, u, d in sorted(rows, key=lambda r: (r[1], r[0])):
        before = [(uu, dd) for _, _, uu, dd in seen]
        ub = sum(1 for uu, _ in before if uu == u)
        db = len({uu for uu, dd in before if dd == d})
        seen.append((i, m, u, d))
        after = before + [(u, d)]
        out[i] = (ub, db, ub + 1, len({uu for uu, dd in after if dd == d}))
    return out


def test_degree_boundaries(spark):
    rows = [(k, k, "u1", "d1") for k in range(7)]                       # 5th, 6th, 7th edge of u1
    rows += [(10 + k, 10 + k, f"v{k}", "d2") for k in range(5)]         # 3rd, 4th, 5th user of d2
    rows += [(20, 20, "v0", "d2")]                                      # repeated edge
    h = {r["id"]: (r["user_degree"], r["device_degree"], r["user_edges_incl"], r["device_users_incl"])
         for r in history.graph_history(_log(spark, rows)).collect()}
    assert h == _brute_history(rows)
    assert h[5][2] == 6 and h[4][2] == 5          # > 5 fires at the 6th edge
    assert h[13][3] == 4 and h[12][3] == 3        # > 3 fires at the 4th distinct user
    assert h[20][1] == 5 and h[20][3] == 5        # a repeated user adds nothing


def test_history_random_vs_brute(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 400), f"u{rnd.randint(0, 12)}", f"d{rnd.randint(0, 5)}") for i in range(300)]
    got = {r["id"]: (r["user_degree"], r["device_degree"], r["user_edges_incl"], r["device_users_incl"])
           for r in history.graph_history(_log(spark, rows), width_seconds=3600).collect()}
    assert got == _brute_history(rows)
    # equi-depth buckets of ~37 rows (many buckets, hot users spread over them)
    got = {r["id"]: (r["user_degree"], r["device_degree"], r["user_edges_incl"], r["device_users_incl"])
           for r in history.graph_history(_log(spark, rows), target_rows=37).collect()}
    assert got == _brute_history(rows)


def _uf_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = {n for e in edges for n in e}
    comp = {}
    for n in nodes:
        comp.setdefault(find(n), set()).add(n)
    return {n: min(c) for c in comp.values() for n in c}


def test_components_vs_union_find(spark):
    rnd = random.Random(3)
    edges = [(f"user_{rnd.randint(0, 60)}", f"device_{rnd.randint(0, 60)}") for _ in range(70)]
    df = spark.createDataFrame(edges, "user string, device string")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == _uf_components(edges)


def test_cluster_sizes_and_numbering(spark):
    edges = [("user_a", "device_1"), ("user_b", "device_1"), ("user_c", "device_1")]            # size 4
    edges += [("user_d", "device_2"), ("user_e", "device_2"), ("user_f", "device_2"), ("user_g", "device_2")]  # 5
    edges += [("user_h", "device_3"), ("user_i", "device_3"), ("user_j", "device_3"), ("user_k", "device_3"),
              ("user_l", "device_3")]                                                              # 6
    df = spark.createDataFrame(edges, "user string, device string")
    cl = graph.fraud_clusters(graph.connected_components(df)).collect()
    by_id = {}
    for r in cl:
        by_id.setdefault(r["cluster_id"], (r["size"], r["risk"], set()))[2].add(r["node"])
    assert {k: (v[0], v[1]) for k, v in by_id.items()} == {"Cluster-1": (6, "high"), "Cluster-2": (5, "medium")}


def _brute_cluster_asof(rows):
    out = {}
    seen = []
    for i, m, u, d in sorted(rows, key=lambda r: (r[1], r[0])):
        seen.append((u, d))
        comp = _uf_components(seen)
        out[i] = sum(1 for n in comp if comp[n] == comp[u]) > 4
    return out


def test_cluster_flag_asof_vs_union_find(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, rnd.randint(0, 200), f"user_{rnd.randint(0, 25)}", f"device_{rnd.randint(0, 25)}")
                for i in range(60)]
        got = {r["id"]: r["in_cluster"] for r in graph.cluster_flag_asof(_log(spark, rows)).collect()}
        assert got == _brute_cluster_asof(rows)


def test_merge_of_two_components_by_later_edge(spark):
    rows = [(1, 1, "user_a", "device_1"), (2, 2, "user_b", "device_1"),      # component {a, b, 1}
            (3, 3, "user_c", "device_2"),                                     # component {c, 2}
            (4, 4, "user_a", "device_2")]                                     # merge: 5 nodes
    got = {r["id"]: r["in_cluster"] for r in graph.cluster_flag_asof(_log(spark, rows)).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}


def test_components_chains_and_hubs(spark):
    # a long path and a hub whose leaves reach it through different smaller nodes
    edges = [(f"user_{i:03d}", f"device_{i:03d}") for i in range(40)]
    edges += [(f"user_{i + 1:03d}", f"device_{i:03d}") for i in range(39)]
    edges += [("user_900", f"device_{i:03d}") for i in range(50, 60)] + [("user_901", "device_055")]
    df = spark.createDataFrame(edges, "user string, device string")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == _uf_components(edges)


def test_components_of_numbers_chains_and_colliding_hashes(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(-300, 300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 5)], "user long, device long")
    written, real = [], graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df, name: (written.append(name), real(df, name))[1])
    got = {r["node"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert got == {i: -300 for i in range(-300, 301)} | {1000: 1000, 1001: 1000}
    assert written.count("edges-left") <= 15                             # sorted chains shrink by shares, not by a node a round

    hashes = graph.F.xxhash64

    def meeting(*columns):                                               # a salt under which all names meet
        return graph.F.lit(1).cast("long") if len(columns) == 2 and columns[0]._jc.toString() == "0" else hashes(*columns)
    monkeypatch.setattr(graph.F, "xxhash64", meeting)
    names = spark.createDataFrame([("a", "b"), ("c", "d"), ("b", "e")], "user string, device string")
    assert {tuple(r) for r in graph.connected_components(names).collect()} == {("a", "a"), ("b", "a"), ("e", "a"), ("c", "c"), ("d", "c")}


def test_cluster_times_in_tasks_and_by_rounds(spark):
    rng = random.Random(5)
    rows = [(i, None if rng.random() < 0.1 else rng.randrange(40), f"u{rng.randrange(30)}", f"d{rng.randrange(45)}") for i in range(60)]
    rows += [(60, 3, None, "d1"), (61, 3, "u1", None), (62, 4, "same", "same")]
    df = spark.createDataFrame(rows, "id long, s long, user string, device string").select("id", graph.F.timestamp_seconds("s").alias("ts"), "user", "device")
    tasks, both = ({r["user"]: tuple(r["_tstar"]) for r in graph.cluster_times(df, one_task=n).collect()} for n in (1000, 8))
    assert tasks == both and 5 < len(tasks) < 75


def test_history_with_stored_state(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 400), f"u{rnd.randint(0, 9)}", f"d{rnd.randint(0, 4)}") for i in range(200)]
    full = _brute_history(rows)
    early = [r for r in rows if r[1] < 250]
    late = [r for r in rows if r[1] >= 250]
    state = history.state_increments(None, _log(spark, early))
    got = {r["id"]: (r["user_degree"], r["device_degree"], r["user_edges_incl"], r["device_users_incl"])
           for r in history.graph_history(_log(spark, late), prior=state).collect()}
    assert got == {r[0]: full[r[0]] for r in late}
    more = history.state_increments(state, _log(spark, late))
    pairs = lambda rs: {(d, u) for _, _, u, d in rs}
    assert {tuple(r) for r in more.pairs.select("device", "user").collect()} == pairs(late) - pairs(early)


def _brute_times(rows, k=5):
    """Per node the (minute, id) of the row with which its component has k nodes."""
    group, out = {}, {}
    for i, m, u, d in sorted(rows, key=lambda r: (r[1], r[0])):
        both = group.setdefault(u, {u}) | group.setdefault(d, {d})
        for x in both:
            group[x] = both
            if len(both) >= k:
                out.setdefault(x, (m, i))
    return out


def test_cluster_lists_by_increments(spark):
    """Random batches of edges: after each one the lists give the times that union-find gives over all rows so far."""
    from pyspark.sql import functions as F
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, i // 2, f"u{rnd.randint(0, 25)}", f"d{rnd.randint(0, 18)}") for i in range(40)]
        stored = spark.createDataFrame([], graph.LISTS_SCHEMA)
        for lo, hi in ((0, 8), (8, 22), (22, 40)):
            lists = graph.grown_cluster_lists(_log(spark, rows[lo:hi]), lambda nodes: stored.join(nodes, "node", "left_semi"))
            stored = stored.join(lists.select("node"), "node", "left_anti").unionByName(lists).checkpoint()
            got = {r["node"]: (r["t"], r["i"]) for r in stored.where(F.size("lst") >= 5)
                   .select("node", F.expr("lst[4].b.t").alias("t"), F.expr("lst[4].b.i").alias("i")).collect()}
            micros = lambda m: int((T0 + dt.timedelta(minutes=m)).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
            assert got == {x: (micros(m), i) for x, (m, i) in _brute_times(rows[:hi]).items()}


def test_history_keeps_rows_without_time(spark):
    rows = [(1, None, "u1", "d1"), (2, 5, "u1", "d1"), (3, 6, "u2", "d1")]
    df = spark.createDataFrame([(i, None if m is None else T0 + dt.timedelta(minutes=m), u, d) for i, m, u, d in rows],
                               "id long, ts timestamp, user string, device string")
    for kw in ({}, {"width_seconds": 60}, {"target_rows": 1}):
        got = {r["id"]: (r["user_degree"], r["device_degree"]) for r in history.graph_history(df, **kw).collect()}
        assert got == {1: (0, 0), 2: (1, 1), 3: (0, 1)}


def test_growing_components_after_every_batch(spark):
    import tempfile
    from riskloom.streaming.components import GrowingComponents
    rnd = random.Random(5)
    edges = [(f"u{rnd.randint(0, 60)}", f"d{rnd.randint(0, 60)}") for _ in range(55)] + [(f"u{i}", f"d{i + 1}") for i in range(100, 110)]
    rnd.shuffle(edges)
    edges += [(f"u{i + 1}", f"d{i + 1}") for i in range(109, 99, -1)]           # merges a chain from its far end, root by root
    growing = GrowingComponents(tempfile.mkdtemp(prefix="rl-grow-", dir="/tmp"), buckets=4)
    cuts = [0, 20, 40, 41, 66, 70, 75]
    for batch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(edges[lo:hi] + [("u1", None), ("u2", "u2")], "user string, device string")
        if batch == 2:
            growing.add(spark.createDataFrame([("u1", "zz")], "user string, device string"), batch)     # a first attempt, replaced
        touched = {r["node"]: r["component"] for r in growing.add(part, batch).collect()}
        want = _uf_components(edges[:hi])
        assert {r["node"]: r["component"] for r in growing.labels(spark, batch + 1).collect()} == want
        assert touched == {n: want[n] for e in edges[lo:hi] for n in e}


def test_growing_components_write_little(spark):
    """One new edge between two large components writes a few pointers, whatever their size."""
    import tempfile
    from riskloom.streaming.components import GrowingComponents
    path = tempfile.mkdtemp(prefix="rl-grow2-", dir="/tmp")
    growing = GrowingComponents(path)
    two = [(f"a{i:03d}", "a_hub") for i in range(200)] + [(f"b{i:03d}", "b_hub") for i in range(200)]
    growing.add(spark.createDataFrame(two, "user string, device string"), 0)
    growing.add(spark.createDataFrame([("b150", "a_hub")], "user string, device string"), 1)
    assert {(r["node"], r["parent"]) for r in spark.read.parquet(f"{path}/pointers/tier=0/since=1").collect()} == {("b150", "a000"), ("b000", "a000")}
    assert {r["component"] for r in growing.labels(spark, 2).collect()} == {"a000"}


def test_full_cluster_lists_take_no_rounds(spark, monkeypatch):
    """New links between nodes whose lists are full: nothing changes and no round runs; one new node makes rounds for itself alone."""
    first = [(i, i, f"u{i}", "d0") for i in range(6)]
    stored = graph.grown_lists(graph.edge_links(_log(spark, first)).checkpoint(), lambda nodes: spark.createDataFrame([], graph.LISTS_SCHEMA))
    assert {r["changed"] for r in stored.collect()} == {True}
    stored = stored.select("node", "lst").checkpoint()
    lookup = lambda nodes: stored.join(nodes, "node", "left_semi")
    rounds, keep = [], graph._relaxed
    monkeypatch.setattr(graph, "_relaxed", lambda adj, lists, *a, **kw: (rounds.append({r["v"] for r in lists.collect()}), keep(adj, lists, *a, **kw))[1])
    again = graph.grown_lists(graph.edge_links(_log(spark, [(10, 20, "u1", "d0"), (11, 21, "u2", "d0")])).checkpoint(), lookup)
    assert {(r["node"], r["changed"]) for r in again.collect()} == {("u1", False), ("u2", False), ("d0", False)} and not rounds
    more = {r["node"]: r for r in graph.grown_lists(graph.edge_links(_log(spark, [(12, 30, "u1", "d0"), (13, 31, "new", "d0")])).checkpoint(), lookup).collect()}
    assert rounds == [{"new"}] and [n for n, r in more.items() if r["changed"]] == ["new"]
    assert [e["b"]["i"] for e in more["new"]["lst"]][1:] == [13] * 4


def test_history_with_given_first_rows(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 90), f"u{rnd.randint(0, 9)}", f"d{rnd.randint(0, 4)}") for i in range(200)]
    firsts = graph.edge_links(_log(spark, rows)).select("device", "user", "first.ts", "first.id").checkpoint()
    for kw in ({}, {"target_rows": 37}, {"width_seconds": 600}):
        got = {r["id"]: (r["user_degree"], r["device_degree"], r["user_edges_incl"], r["device_users_incl"])
               for r in history.graph_history(_log(spark, rows), firsts=firsts, **kw).collect()}
        assert got == _brute_history(rows)
