"""Embedding near copies against a comparison of all pairs."""

import math

import numpy as np
import pytest

from riskloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=E.THRESHOLD):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label), by all pairs."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    unit = []
    for _, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = unit[i] @ unit[j] >= threshold
    group = list(range(n))
    for i, j in zip(*np.nonzero(near)):
        a, b = group[i], group[j]
        group = [a if g == b else g for g in group] if a != b else group
    low = {g: min((rows[i][0] for i in range(n) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted((str(rows[i][0]), int(near[i].sum()), low[group[i]], low[group[i]] == rows[i][0]) for i in range(n))


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def clouds(seed, sizes, noise, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for k, size in enumerate(sizes):
        centre = rng.normal(size=dim)
        for _ in range(size):
            v = centre / np.linalg.norm(centre) + rng.normal(size=dim) * noise[k % len(noise)] / math.sqrt(dim)
            rows.append([0, [float(c) for c in np.float32(v * rng.uniform(0.1, 9))], k % 3])
    order = rng.permutation(len(rows))
    return [(int(order[i]), *r[1:]) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def crowd():
    rows = clouds(1, [90, 40, 40, *[3] * 20, *[1] * 60], [0.12, 0.2, 0.26])
    return rows + [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]        # copies


@pytest.mark.parametrize("limits", [{}, {"block_rows": 16, "group_rows": 64, "crowded": 1 << 20}, {"block_rows": 16, "group_rows": 64, "crowded": 2}],
                         ids=["whole buckets", "blocks", "hubs and blocks"])
def test_all_links_are_found_and_counted_once(spark, crowd, limits):
    df = spark.createDataFrame(crowd, SCHEMA).repartition(3)
    got, expected = result(E.embedding_dedup(df, **limits)), brute(crowd)
    assert all(g[1] <= e[1] for g, e in zip(got, expected))
    assert sum(g[1] for g in got) >= 0.99 * sum(e[1] for e in expected) > 0
    assert np.mean([g[2:] == e[2:] for g, e in zip(got, expected)]) >= 0.99


def test_with_every_bucket_probed_nothing_is_missed(spark):
    """Few axes and many probes: all candidates meet, and the counts are exact, in every way of cutting."""
    rows = clouds(2, [25, 25, 8, 8, 1, 1], [0.3, 0.45], dim=4)
    df, expected = spark.createDataFrame(rows, SCHEMA), brute(rows)
    for limits in ({}, {"block_rows": 5, "group_rows": 10, "crowded": 1}, {"block_rows": 5, "group_rows": 10, "crowded": 1000}):
        assert result(E.embedding_dedup(df, tables=6, probes=7, **limits)) == expected


def test_recall_near_the_threshold():
    """Share of pairs at a cosine of exactly the threshold that share a bucket."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = E.THRESHOLD * x + math.sqrt(1 - E.THRESHOLD ** 2) * y
    turns = E.Rotations(64, E.TABLES, E.SEED)
    a, b = (E.buckets(v, turns, E.TABLES, E.PROBES) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.97


def test_rotations_keep_lengths_and_angles():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 48))
    y = E.Rotations(48, 2, 1).turned(x, 1, 0)
    assert np.allclose(x @ x.T, y @ y.T)


def test_rows_that_link_with_nothing(spark):
    v, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0),
            (8, [float("inf"), 0.0, 0.0], 0), (9, [1.0, None, 0.0], 0), (10, v, 1), (11, [1.0, 0.0], 0), (12, far, 0), (13, [1e-30, 0.0, 0.0], 0)]
    got = result(E.embedding_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert {r[0]: r[1] for r in got if r[1]} == {"1": 2, "2": 2, "13": 2}


def test_shared_and_missing_identifiers_ties_and_other_columns(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(5, v, 0), (5, v, 0), (None, v, 0), (5, w, 0), (None, w, 1), (3, [0.99, 0.1, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS weight", "'x' AS hub", "3 AS n_links", "4 AS dim", "5 AS vec")
    got = result(E.embedding_dedup(df))
    assert got == sorted([("5", 3, 3, False), ("5", 3, 3, False), ("None", 3, 3, False), ("5", 0, 5, True), ("None", 0, None, True), ("3", 3, 3, True)])


def test_empty_tables_and_doubles(spark):
    assert result(E.embedding_dedup(spark.createDataFrame([], SCHEMA))) == []
    assert result(E.embedding_dedup(spark.createDataFrame([(1, None, 0)], SCHEMA))) == [("1", 0, 1, True)]
    doubles = spark.createDataFrame([(1, [1e300, 1e300], "a"), (2, [1e-300, 1e-300], "a"), (3, [1.0, -1.0], "a")], "vec_id int, embedding array<double>, label string")
    assert result(E.embedding_dedup(doubles)) == [("1", 1, 1, True), ("2", 1, 1, False), ("3", 0, 3, True)]
