"""Model fitting and scoring.

* Boosted trees: second-order boosting on histograms (``riskloom.operators.boosting``) with the reference's
  settings (200 rounds, depth 6, rate 0.05, row and column sampling 0.8, positive-class weight). Its library is not
  available, so draws and bins differ and with them the trees.
* Isolation forest: MLlib has none. Every tree draws its own rows by seeded hashes (a row may serve
  several trees), trees are grown in parallel with ``groupBy(tree).applyInPandas`` on ``psi`` rows
  each, the tree table (at most trees x 511 nodes) goes out with the scoring function, and an Arrow
  ``pandas_udf`` over the features alone returns the one score column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.features import known
from riskloom.operators.boosting import BoostedTrees, fit_boosted_trees
from riskloom.operators.selection import exact_order_stats
from riskloom.session import checkpoint_dir

# Model settings of the reference.
GBT_ROUNDS, GBT_DEPTH, GBT_RATE, GBT_SUBSAMPLE, GBT_COLSAMPLE = 200, 6, 0.05, 0.8, 0.8
GRAPH_GBT_RATE, GRAPH_POS_WEIGHT = 0.1, 30.0
IF_TREES, IF_MAX_SAMPLES, IF_CONTAMINATION = 100, 256, 0.02
SEED = 42
POOL = 200      # the rows that the trees draw from: at most this many trees' worth (a fitting bound)


def class_weight(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """M3: negatives / positives, 1.0 when there are no positives (one aggregate)."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return c.select(F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.col("neg") / F.col("pos"))
                    .alias("scale_pos_weight"))


def fit_fraud_model(train: DataFrame, features: Sequence[str], label: str = "isFraud",
                    rounds: int = GBT_ROUNDS, depth: int = GBT_DEPTH, rate: float = GBT_RATE,
                    pos_weight: float | None = None, seed: int = SEED) -> BoostedTrees:
    """M1 (and M2 with ``rate=0.1, pos_weight=30`` and degree columns among the features)."""
    w = pos_weight if pos_weight is not None else class_weight(train, label).first()[0]
    return fit_boosted_trees(train, features, label, rounds, depth, rate, float(w), GBT_SUBSAMPLE, GBT_COLSAMPLE, seed)


def predict_probability(model: BoostedTrees, df: DataFrame, out: str = "fraud_probability") -> DataFrame:
    """Positive-class probability as a plain double column."""
    return model.with_probability(df, out)


def predict_probability_from(model: BoostedTrees, df: DataFrame, columns: Sequence[str],
                             out: str = "fraud_probability") -> DataFrame:
    """Score with the fitted trees, reading the features from ``columns`` (same order as training)."""
    return model.with_probability(df, out, columns)


def save_model(model: BoostedTrees, path: str) -> None:
    """Persist the fitted trees."""
    model.save(SparkSession.getActiveSession(), path)


def load_model(path: str) -> BoostedTrees:
    return BoostedTrees.load(SparkSession.getActiveSession(), path)


# ---------------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, n_features: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(SEED * 100_003 + tree)
    x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, n_features))
    rows = []

    def build(idx, depth):
        node = len(rows)
        rows.append(None)
        sub = x[idx]
        if len(idx) <= 1 or depth >= max_depth:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if len(candidates) == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(candidates))
        thr = float(rng.uniform(lo[f], hi[f]))
        left_mask = sub[:, f] <= thr
        rows[node] = (tree, node, f, thr, -1, -1, len(idx), depth)
        left = build(idx[left_mask], depth + 1)
        right = build(idx[~left_mask], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
        return node

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def _values(df: DataFrame, features: Sequence[str]) -> list:
    """The features; null and NaN count as 0."""
    return [F.coalesce(known(df, c).cast("double"), F.lit(0.0)) for c in features]


def _vector(df: DataFrame, features: Sequence[str]):
    """The features as one array."""
    return F.array(*_values(df, features))


TREE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size long, depth int")


class IsolationForestModel:
    def __init__(self, features: list[str], trees: pd.DataFrame, max_samples: int, offset: float | None = None):
        self.features, self.trees, self.max_samples, self.offset = features, trees, max_samples, offset

    def score_samples(self, df: DataFrame, out: str = "_if_score", columns: Sequence[str] | None = None) -> DataFrame:
        """sklearn convention: the negated anomaly score 2^(-E[h]/c(psi)) (higher = more normal).
        Missing features count as 0."""
        norm, by_tree = _c(self.max_samples), []
        for _, g in self.trees.groupby("tree"):
            g = g.sort_values("node")
            adj = g["depth"].to_numpy() + np.array([_c(v) for v in g["size"].to_numpy()])
            feat = g["feature"].to_numpy(np.int64)
            # the children of node n are 2n (at most the threshold) and 2n + 1 of the table; a leaf leads to itself
            kids = np.where(feat[:, None] >= 0, g[["left", "right"]].to_numpy(np.int64), np.arange(len(feat))[:, None]).reshape(-1)
            by_tree.append((np.maximum(feat, 0), g["threshold"].to_numpy(), kids, int(g["depth"].max()), adj))

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            n = len(values[0])
            flat, total, row = np.concatenate([v.to_numpy(float) for v in values]), np.zeros(n), np.arange(n)
            for feat, thr, kids, max_depth, adj in by_tree:
                node, begin = np.zeros(n, np.int64), feat * n
                for _ in range(max_depth):
                    node = kids.take(2 * node + (flat.take(begin.take(node) + row) > thr.take(node)))
                total += adj.take(node)
            mean = total / max(1, len(by_tree))
            return pd.Series(-np.power(2.0, -mean / norm) if norm > 0 else np.full(n, -1.0))

        return df.withColumn(out, score(*(_values(df, list(columns or self.features)) or [F.lit(0.0)])))

    def save(self, spark, path: str) -> None:
        """The tree table and one row of settings."""
        spark.createDataFrame(self.trees, TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
        (spark.createDataFrame([(self.features, self.max_samples, self.offset)], "features array<string>, max_samples int, offset double")
         .write.mode("overwrite").parquet(f"{path}/settings"))

    @classmethod
    def load(cls, spark, path: str) -> "IsolationForestModel":
        row = spark.read.parquet(f"{path}/settings").first()
        return cls(list(row["features"]), spark.read.parquet(f"{path}/trees").toPandas(), row["max_samples"], row["offset"])

    def anomaly_score(self, df: DataFrame, out: str = "anomaly_score", columns: Sequence[str] | None = None) -> DataFrame:
        """M5: 1 - decision value, decision = score_samples - offset."""
        s = self.score_samples(df, columns=columns)
        return s.withColumn(out, F.lit(1.0) - (F.col("_if_score") - F.lit(self.offset))).drop("_if_score")


def _unit(h):
    """A 64-bit hash as a number from 0 to 1."""
    return (h.cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)


def fit_isolation_forest(train: DataFrame, features: Sequence[str], trees: int = IF_TREES,
                         max_samples: int = IF_MAX_SAMPLES, contamination: float = IF_CONTAMINATION,
                         seed: int = SEED) -> IsolationForestModel:
    """M4: ``trees`` isolation trees on ``max_samples`` rows each (depth limit ceil(log2 psi)),
    offset = the ``contamination`` percentile of the training scores (exact, linear interpolation)."""
    feats = list(features)
    # rows are drawn by all their columns (their key among them), so that equal vectors are drawn apart
    rows = train.select(_vector(train, feats).alias("x"), F.xxhash64(F.lit(seed), *train.columns).alias("_u"))
    n = rows.count()
    psi = int(min(max_samples, n))
    depth = int(math.ceil(math.log2(max(psi, 2))))
    # a pool of rows bounded by POOL trees' worth, from which every tree draws on its own; both
    # draws are hashes of row, tree and seed, so the model doesn't depend on partitioning
    share = min(1.0, POOL * psi / max(n, 1))
    pool = rows.where(_unit(F.col("_u")) < share)
    expected = max(1.0, n * share)
    cut = 1.0 if expected <= 4 * psi else (psi + 8 * math.sqrt(psi) + 16) / expected
    drawn = (pool.select("x", F.explode(F.expr(f"filter(transform(sequence(0, {trees - 1}), t -> named_struct('tree', t, 'r', xxhash64(_u, t))), "
                                               f"s -> (s.r + 9223372036854775808BD) / 18446744073709551616BD < {cut!r})")).alias("d"))
             .select(F.col("d.tree").alias("tree"), F.col("d.r").alias("_r"), "x"))
    first = Window.partitionBy("tree").orderBy("_r", "x")
    drawn = drawn.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= psi).select("tree", "x")
    nf = len(feats)
    table = drawn.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf.assign(_s=pdf["x"].map(tuple)).sort_values("_s"), nf, depth),
                                                TREE_SCHEMA).toPandas()
    model = IsolationForestModel(feats, table, psi)
    checkpoint_dir(train.sparkSession)
    scored = model.score_samples(train.select(*feats)).select("_if_score").checkpoint()
    pos = contamination * (n - 1)
    k = int(math.floor(pos))
    stats = exact_order_stats(scored, {"_if_score": [k + 1, min(k + 2, n)]})["_if_score"]
    lo, hi = stats[k + 1], stats[min(k + 2, n)]
    model.offset = lo + (hi - lo) * (pos - k)
    return model
