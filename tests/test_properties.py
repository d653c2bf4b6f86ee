"""Property tests (hypothesis): components and as-of clusters vs union-find, split sizes, metrics."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskloom.operators import graph, metrics, sampling

from test_graph import _brute_cluster_asof, _log, _uf_components
from test_metrics_reports import _ap, _auc

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

edge_lists = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=30)


@SETTINGS
@given(edge_lists)
def test_components_property(spark, pairs):
    edges = [(f"user_{a}", f"device_{b}") for a, b in pairs]
    df = spark.createDataFrame(edges, "user string, device string")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == _uf_components(edges)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=30))
def test_cluster_asof_property(spark, rows):
    log = [(i, m, f"user_{u}", f"device_{d}") for i, (m, u, d) in enumerate(rows)]
    got = {r["id"]: r["in_cluster"] for r in graph.cluster_flag_asof(_log(spark, log)).collect()}
    assert got == _brute_cluster_asof(log)


@SETTINGS
@given(st.integers(1, 400), st.integers(1, 60), st.floats(0.05, 0.5))
def test_split_sizes_property(spark, n0, n1, size):
    rows = [(i, 1 if i < n1 else 0) for i in range(n0 + n1)]
    s = sampling.stratified_split(spark.createDataFrame(rows, "TransactionID long, isFraud int"), "isFraud", size, 42)
    got = {r["isFraud"]: r["count"] for r in s.where("split = 'validation'").groupBy("isFraud").count().collect()}
    for label, n in ((1, n1), (0, n0)):
        want = int(n * size + 0.5)
        assert got.get(label, 0) == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60)
       .filter(lambda p: {y for y, _ in p} == {0, 1}))
def test_auc_ap_property(spark, pairs):
    data = [(y, s / 6) for y, s in pairs]
    df = spark.createDataFrame(data, "isFraud int, fraud_probability double")
    assert abs(metrics.roc_auc(df).first()[0] - _auc(data)) < 1e-12
    assert abs(metrics.average_precision(df).first()[0] - _ap(data)) < 1e-12
