"""Boosted trees against a plain grower, forest draws, and the written preprocessor."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import metrics, models
from riskloom.operators import preprocessor as P
from riskloom.sources.fixtures import fixture

from conftest import SF001


def _grow(x, y, weight, rounds, depth, rate):
    """Boosting by trying every value of every feature: list of trees (nested tuples), ties as in the docstring."""
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1.0)
        g, h = np.rint(w * (p - y) / B.UNIT) * B.UNIT, np.rint(w * p * (1 - p) / B.UNIT) * B.UNIT

        def node(rows, d):
            G, H = g[rows].sum(), h[rows].sum()
            best = (B.MIN_GAIN, None)
            for f in range(x.shape[1]) if d < depth else ():
                v = x[rows, f]
                none = np.isnan(v)
                for cut in sorted(set(x[~np.isnan(x[:, f]), f]))[:-1]:
                    for none_left in (True, False):
                        left = np.where(none, none_left, v <= cut)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if hl >= 1 and H - hl >= 1:
                            gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, cut, none_left, left))
            if best[1] is None:
                margin[rows] += -rate * G / (H + 1)
                return -rate * G / (H + 1)
            f, cut, none_left, left = best[1]
            return f, cut, none_left, node(rows[left], d + 1), node(rows[~left], d + 1)

        trees.append(node(np.arange(len(y)), 0))
    return trees, 1 / (1 + np.exp(-margin))


def _nested(tree, model, n=0):
    f = tree.feature[n]
    if f < 0:
        return tree.value[n]
    return int(f), model.cuts[model.features[f]][tree.cut[n] - 1], bool(tree.none_left[n]), _nested(tree, model, 2 * n + 1), _nested(tree, model, 2 * n + 2)


def _same(a, b):
    return np.isclose(a, b, atol=1e-9) if not isinstance(a, tuple) else isinstance(b, tuple) and a[:3] == b[:3] and all(_same(u, v) for u, v in zip(a[3:], b[3:]))


def _rows(seed, n=400):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 30, n), rng.integers(0, 7, n), rng.integers(-5, 6, n)], axis=1).astype(float)
    y = ((x[:, 0] > 14) ^ (x[:, 1] > 3) | (x[:, 2] == 2)).astype(float)
    y = np.where(rng.random(n) < 0.1, 1 - y, y)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "TransactionID long, a double, b double, c double, isFraud int")


def test_trees_equal_a_plain_grower_however_the_rows_are_dealt(spark):
    x, y = _rows(1)
    trees, p = _grow(x, y, 2.5, 3, 3, 0.3)
    for parts, block in ((1, 1 << 16), (5, 37)):
        df = _frame(spark, x, y).repartition(parts)
        model = B.fit_boosted_trees(df, ["a", "b", "c"], "isFraud", 3, 3, 0.3, 2.5, block_rows=block)
        assert all(_same(t, _nested(m, model)) for t, m in zip(trees, model.trees, strict=True))
        got = {r["TransactionID"]: r["fraud_probability"] for r in model.with_probability(df).collect()}
        assert np.allclose([got[i] for i in range(len(y))], p)


def test_rows_and_columns_are_drawn_per_tree_and_repeatable(spark):
    x, y = _rows(2)
    fit = lambda parts: B.fit_boosted_trees(_frame(spark, x, y).repartition(parts), ["a", "b", "c"], "isFraud", 4, 2, 0.3, 1.0, 0.7, 0.67, block_rows=90)
    one, two = fit(1), fit(3)
    assert [_nested(t, one) for t in one.trees] == [_nested(t, two) for t in two.trees]
    h = np.random.default_rng(0).integers(0, 1 << 62, 20_000).astype(np.uint64)
    assert abs((B._mixed(h, 5) < 0.7).mean() - 0.7) < 0.02 and abs(((B._mixed(h, 5) < 0.7) & (B._mixed(h, 6) < 0.7)).mean() - 0.49) < 0.02


def test_margins_are_made_up_for_whatever_a_worker_has_missed():
    x = np.random.default_rng(1).integers(0, 9, (50, 2)).astype(np.uint8)
    trees = []
    for k in range(5):
        t = B.Tree(1)
        t.feature[0], t.cut[0], t.value[1], t.value[2] = k % 2, 1 + k, k + 1, -k
        trees.append(t)
    held, fresh = B.Margins(), B.Margins()
    held.of((0, 0), x, trees[:2])
    assert (held.of((0, 0), x, trees) == fresh.of((0, 0), x, trees)).all()
    assert (held.of((0, 0), x, trees[:1]) == B.Margins().of((0, 0), x, trees[:1])).all()      # an older job, run again
    held.ROWS = 60
    for k in range(4):
        held.of((0, k), x, trees)
    assert len(held.held) == 1


def test_blocks_beyond_the_bound_do_not_drive_out_those_kept():
    x, trees = np.random.default_rng(1).integers(0, 9, (50, 2)).astype(np.uint8), [B.Tree(1) for _ in range(3)]
    own = B.Margins()
    own.ROWS = 120                              # two blocks of three
    for _ in range(4):
        for k in range(3):                      # each round used to make the margins of all three anew
            own.of((0, k), x, trees)
    assert set(own.held) == {(0, 0), (0, 1)}
    for n in range(1, 4):                       # a block that is not used any more gives way
        for k in (1, 2):
            own.of((0, k), x, trees + [B.Tree(1) for _ in range(n)])
    assert set(own.held) == {(0, 1), (0, 2)}


def test_a_tree_gives_its_leaves_to_the_margins_without_a_second_descent(monkeypatch):
    rng = np.random.default_rng(2)
    x, h, tree = rng.integers(0, 9, (80, 3)).astype(np.uint8), rng.integers(0, 1 << 62, 80).astype(np.uint64), B.Tree(2)
    tree.feature[:3], tree.cut[:3], tree.none_left[:3], tree.value[:] = [1, 0, 2], [4, 3, 6], [True, False, True], np.arange(7) / 8
    plain = [next(2 * n + 2 - (tree.none_left[n] if r[tree.feature[n]] == 0 else r[tree.feature[n]] <= tree.cut[n])
                  for n in [2 - (tree.none_left[0] if r[1] == 0 else r[1] <= 4)]) for r in x]
    assert tree.leaves(x).tolist() == plain and tree.leaves(np.asfortranarray(x)).tolist() == plain
    own = B.Margins()
    own.of((0, 0), x, [])
    for level in range(2):
        own.nodes((0, 0), h, x, tree, 0, level, 0.5)
    monkeypatch.setattr(B.Tree, "leaves", None)
    assert own.of((0, 0), x, [tree]).tolist() == tree.value[plain].tolist()


def test_margins_outlast_tasks_of_another_stage(spark, monkeypatch):
    x, y = _rows(3, 300)
    fit = lambda: B.fit_boosted_trees(_frame(spark, x, y).repartition(6), ["a", "b", "c"], "isFraud", 4, 3, 0.3, 1.0, 0.8, block_rows=20)
    merged = fit()
    monkeypatch.setattr(B, "MERGED_BYTES", 0)                           # every level in two stages
    assert [_nested(t, merged) for t in merged.trees] == [_nested(t, merged) for t in fit().trees]
    rdd, shared = spark.sparkContext.parallelize(range(8), 4), spark.sparkContext.broadcast(B.Margins())

    def seen(part, rows):
        shared.value.calls = getattr(shared.value, "calls", 0) + 1
        yield 0, np.full((1, 3, 2), float(shared.value.calls))
    for _ in range(4):
        calls = rdd.mapPartitionsWithIndex(seen).collect()
        rdd.mapPartitionsWithIndex(seen).reduceByKey(np.add, 4).map(B._splits(shared, 1.0, 1.0)).collect()
    assert max(c[1].max() for c in calls) > 2


def test_lighter_children_give_the_sums_of_all():
    sums = np.arange(4 * 3 * 2).reshape(4, 3, 2)
    above = np.stack([sums[0] + sums[1], sums[2] + sums[3]])
    assert (B._completed(sums[[1, 2]], [1, 2], 2, above) == sums).all()


def test_features_with_many_values_and_degenerate_tables(spark):
    df = spark.range(5000).select(F.col("id").alias("TransactionID"), F.rand(3).alias("u"), F.lit(None).cast("double").alias("none"), F.lit(4).alias("same"))
    df = df.withColumn("isFraud", (F.col("u") > 0.6).cast("int")).checkpoint()
    model = B.fit_boosted_trees(df, ["u", "none", "same"], "isFraud", 8, 2, 0.5)
    assert len(model.cuts["u"]) == B.BINS - 1 and model.cuts["none"] == [] and model.cuts["same"] == []
    assert metrics.roc_auc(model.with_probability(df)).first()[0] > 0.99
    empty = B.fit_boosted_trees(df.limit(0), ["u"], "isFraud", 2, 2, 0.5)
    assert {r[0] for r in empty.with_probability(df.limit(3)).select("fraud_probability").collect()} == {0.5}
    assert B.fit_boosted_trees(df, [], "isFraud", 2, 2, 0.5).trees == []


def test_model_learns_beyond_a_constant_and_is_read_back(spark):
    rows = fixture(spark, SF001, "fx_learn").checkpoint()
    held = F.pmod(F.xxhash64("TransactionID"), F.lit(4)) == 0
    model = models.fit_fraud_model(rows.where(~held), ["quantity", "discount", "tax", "line"], rounds=15, depth=3, rate=0.2)
    assert metrics.roc_auc(models.predict_probability(model, rows.where(held))).first()[0] > 0.8
    path = tempfile.mkdtemp(prefix="rl-bt-", dir="/tmp") + "/m"
    models.save_model(model, path)
    a, b = (models.predict_probability(m, rows).select("TransactionID", "fraud_probability") for m in (model, models.load_model(path)))
    assert a.exceptAll(b).count() == 0


def test_forest_draws_equal_vectors_apart(spark):
    """A vector that most rows share: every tree still grows on its full sample, mostly of that vector."""
    rows = spark.range(30_000).select(F.col("id").alias("TransactionID"), F.when(F.col("id") % 5 < 3, 1.0).otherwise(F.rand(1)).alias("a"),
                                      F.when(F.col("id") % 5 < 3, 2.0).otherwise(F.rand(2)).alias("b")).checkpoint()
    model = models.fit_isolation_forest(rows, ["a", "b"], trees=20)
    roots = model.trees[model.trees["node"] == 0]
    assert set(roots["size"]) == {models.IF_MAX_SAMPLES}


RAW = [("e", 1.0, "x", None, 0), ("e", None, "x", "p", 1), ("f", 3.0, "rare1", "p", 0), (None, 5.0, "x", "p", 0), ("f", 2.0, "x", "q", 1), ("e", None, None, None, 0)]


def _raw(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "TransactionID long, c1 string, n1 double, c2 string, c3 string, isFraud int")


@pytest.mark.parametrize("inside_pipeline", [False, True])
def test_preprocessor_is_written_and_read_back(spark, inside_pipeline):
    from pyspark.ml import Pipeline, PipelineModel
    train = _raw(spark, RAW)
    stage = P.ModelPreprocessor(keep=["TransactionID"], rareThreshold=0.2)
    fitted = Pipeline(stages=[stage]).fit(train) if inside_pipeline else stage.fit(train)
    path = tempfile.mkdtemp(prefix="rl-pp-", dir="/tmp") + "/p"
    fitted.write().overwrite().save(path)
    loaded = (PipelineModel if inside_pipeline else P.ModelPreprocessorModel).load(path)
    new = _raw(spark, [("unseen", None, "rare1", None, 1), (None, 9.0, "x", "q", 0)])
    want = {r["TransactionID"]: tuple(r) for r in fitted.transform(new).collect()}
    assert {r["TransactionID"]: tuple(r) for r in loaded.transform(new).collect()} == want
    # n1: median 2.5; c1: e, f, missing (a null, rare as a value, stays a cell of its own); c2: rare for rare1; c3: q is rare
    assert loaded.transform(new).columns == ["TransactionID", "n1", "c1", "c2", "c3", "isFraud"]
    assert want[0][1:3] == (2.5, -1.0) and want[1][1] == 9.0
    assert loaded.transform(new.drop("isFraud")).columns == ["TransactionID", "n1", "c1", "c2", "c3"]      # rows to score
    with pytest.raises(ValueError):
        loaded.transform(new.drop("c2")).collect()


def test_model_data_is_written_with_its_preprocessor_and_report(spark):
    rows = _raw(spark, [r for r in RAW for _ in range(10)])
    root = tempfile.mkdtemp(prefix="rl-md-", dir="/tmp")
    paths = P.write_model_data(rows, root, "ieee_dev", rare_threshold=0.3, source_path="in.csv")
    train, valid = (spark.read.parquet(paths[k]) for k in ("train", "validation"))
    assert train.columns == ["n1", "c1", "c2", "c3", "isFraud"] and (train.count(), valid.count()) == (48, 12)
    report = spark.read.json(paths["report"]).first()
    assert (report["train_rows"], report["feature_count"], report["source_path"]) == (48, 4, "in.csv")
    assert sorted(r["column"] for r in report["top_rare_category_columns"]) and report["rare_category_columns"] == len(report["top_rare_category_columns"])
    assert P.load_preprocessor(spark, paths["preprocessor"]).transform(rows).count() == 60


@pytest.mark.parametrize("max_bytes", [0, 150, 1 << 20])
@pytest.mark.parametrize("key", [None, "TransactionID"])
def test_codes_are_the_same_on_either_side_of_the_broadcast_bound(spark, max_bytes, key):
    """No column looked up, the smallest ones, or all; the others joined one by one or together by row key."""
    from riskloom.operators import cleaning
    rows = [(i, ["a", "b", None][i % 3], f"v{i % 5}", None if i % 4 else "x", i) for i in range(30)]
    df = spark.createDataFrame(rows, "TransactionID long, c1 string, c2 string, c3 string, n int")
    codes = cleaning.fit_code_table(df.where("TransactionID < 20 AND coalesce(c2, '') <> 'v4'"), ["c1", "c2", "c3"])
    got = cleaning.apply_codes(df, codes, ["c1", "c2", "c3"], key=key, max_bytes=max_bytes)
    assert got.columns == df.columns
    want = [(i, {"a": 0.0, "b": 1.0, None: -1.0}[a], -1.0 if b == "v4" else float(b[1]), -1.0 if c is None else 0.0, n) for i, a, b, c, n in rows]
    assert sorted(map(tuple, got.collect())) == want


def test_models_take_their_features_as_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (400, 3)) / 4
    df = spark.createDataFrame([(i, *map(float, r), int(r[0] + r[1] > 8)) for i, r in enumerate(x)], "id long, a double, b double, c double, isFraud int")
    df = df.withColumn("b", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b")))
    plan = lambda d: d._jdf.queryExecution().toString()             # noqa: E731
    forest = models.fit_isolation_forest(df, ["a", "b", "c"], trees=5, max_samples=64)
    scored = forest.score_samples(df)
    assert "array(" not in plan(scored) and "array(" not in plan(models.predict_probability(models.fit_fraud_model(df, ["a", "b", "c"], rounds=2, depth=2), df))
    got = {r["id"]: r["_if_score"] for r in scored.collect()}
    for r in df.collect():
        v, lengths = [r["a"], 0.0 if r["b"] != r["b"] else r["b"], r["c"]], []
        for _, t in forest.trees.groupby("tree"):
            t = t.set_index("node")
            n = 0
            while t.at[n, "feature"] >= 0:
                n = t.at[n, "left"] if v[t.at[n, "feature"]] <= t.at[n, "threshold"] else t.at[n, "right"]
            lengths.append(t.at[n, "depth"] + models._c(t.at[n, "size"]))
        assert got[r["id"]] == pytest.approx(-2.0 ** (-np.mean(lengths) / models._c(64)))
