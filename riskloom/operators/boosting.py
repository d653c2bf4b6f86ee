"""Boosted trees by gradient and hessian histograms (M1, M2).

Second-order boosting for the logistic loss (Chen and Guestrin, 2016): every tree splits where
``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)`` gains most, rows without a value go to the side that gains more, leaves
are ``-rate * G/(H+l)``, and each tree sees a share of the rows and of the columns.

The rows are binned once and stored as blocks of bounded size. A level of a tree is one aggregate: every block sums
gradient and hessian per (node, feature, bin). The tasks are no more than the cores and their sums don't grow with the rows; where
all of them take at most ``MERGED_BYTES`` the driver adds them up, and then only the lighter child of each split node is summed over
the rows, the other being its parent less that child (sums are whole numbers: the same to the last bit). Beyond
that bound the sums of a feature meet in one task (``reduceByKey``), which returns its best split of each node. A fit is some
thousand short jobs, and planning each as a query would take longer than running it.

Margins are not part of the data: a worker keeps those of the blocks that it has seen, and the nodes that their rows have come to,
and brings them up to date with what was grown since, from none at all if it has to. A lost executor therefore loses nothing
but time. What a worker keeps hangs on a broadcast object, which Spark takes away from a worker that runs a task without it: every
stage of a fit must name it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskloom.functions.features import known
from riskloom.sources.tables import materialised

BINS = 64                   # values of a feature are told apart by at most so many bins (and one for none)
BLOCK_ROWS = 65_536
PART_BLOCKS = 2             # a task takes at least so many blocks: many small ones cost more than they do
MERGED_BYTES = 32 << 20     # sums (tasks x features x nodes x bins) that the driver adds up itself
LAMBDA, MIN_CHILD, MIN_GAIN = 1.0, 1.0, 1e-6
UNIT = 2.0 ** -24           # sums are of whole multiples, so that they don't depend on how the rows are dealt out
SKETCH = 10_000             # accuracy of the quantiles of features with more values than bins


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Upper bounds of each feature's bins but the last: its values, where they are no more than ``bins`` (the largest is no
    bound), else quantiles. Values above the last bound make the last bin."""
    values = {c: known(df, c).cast("double") for c in features}
    if not values:
        return {}
    about = df.agg(*(F.approx_count_distinct(v, 0.02).alias(c) for c, v in values.items())).first().asDict()
    few = [c for c in features if about[c] <= 2 * bins]
    probs = [i / bins for i in range(1, bins)]
    found = df.agg(*(F.collect_set(values[c]).alias(c) if c in few else F.percentile_approx(values[c], probs, SKETCH).alias(c) for c in features)).first().asDict()
    out = {}
    for c in features:
        got = sorted(set(found[c] or []))
        if c in few and len(got) > bins:
            got = [got[math.ceil(len(got) * p) - 1] for p in probs]
        elif c in few:
            got = got[:-1]
        out[c] = got
    return out


def _binned(cuts: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bin numbers from 1 on, feature by feature in memory; 0 for none."""
    out = np.zeros((len(cuts), len(columns[0]) if columns else 0), np.uint8)
    for k, (c, v) in enumerate(zip(cuts, columns)):
        out[k] = np.where(np.isnan(v), 0, np.searchsorted(c, v, "left") + 1)
    return out.T


def _to_blocks(cuts: list[np.ndarray], rows_each: int):
    """``mapInArrow`` over (y, h, features...): blocks as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block():
            y, h, x = (np.concatenate([b[i] for b in held]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes("F")], pa.binary()) for v in (y, h, x)], ["y", "h", "x"])

        for batch in batches:
            for i in range(0, len(batch), rows_each):
                part = batch.slice(i, rows_each)
                columns = [part.column(k + 2).to_numpy(zero_copy_only=False).astype(float) for k in range(len(cuts))]
                held.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.uint8), part.column(1).to_numpy().view(np.uint64), _binned(cuts, columns)))
                n += len(part)
                if n >= rows_each:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()
    return run


class Tree:
    """A binary tree in heap order: children of node n are 2n+1 (bin at most ``cut``; and without a value, if
    ``none_left``) and 2n+2."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth, self.feature = depth, np.full(n, -1, np.int32)
        self.cut, self.none_left, self.value = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n)

    def down(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One level on; rows at a leaf stay."""
        return _step(node, x.T.reshape(-1), np.arange(len(x)), *self.steps(len(x)))

    def steps(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of each node's feature begin among those of ``rows`` rows, and per node and bin the next node."""
        node, b = np.arange(len(self.feature))[:, None], np.arange(256)
        left = np.where(b == 0, self.none_left[:, None], b <= self.cut[:, None])
        to = np.where(self.feature[:, None] < 0, node, 2 * node + 2 - left)
        return np.maximum(self.feature, 0).astype(np.int64) * rows, to.reshape(-1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins comes to."""
        node, row, flat, steps = np.zeros(len(x), np.int64), np.arange(len(x)), x.T.reshape(-1), self.steps(len(x))
        for _ in range(self.depth):
            node = _step(node, flat, row, *steps)
        return node


def _step(node: np.ndarray, flat: np.ndarray, row: np.ndarray, begin: np.ndarray, to: np.ndarray) -> np.ndarray:
    return to.take(node * 256 + flat.take(begin.take(node) + row))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from the rows' hashes and the tree's number (public splitmix64 constants)."""
    x = h + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


class Margins:
    """What a worker keeps of the blocks that it has seen: their margins with the number of trees that these hold, and the nodes of the
    growing tree that their rows have come to. One broadcast object per fit: each worker has its own copy. Any worker of an executor may
    get any of its blocks. What doesn't fit is not kept: those kept stay, unless they were last used before the last tree."""
    ROWS = 24_000_000           # rows that a worker keeps at most, of some 11 bytes each

    def __init__(self):
        self.held: dict = {}
        self.at: dict = {}

    def of(self, block: tuple, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
        done, margin = self.held.pop(block, (0, None))
        done, margin = (0, np.zeros(len(x))) if margin is None or done > len(trees) else (done, margin)
        of_tree, level, node, _ = self.at.get(block, (None, 0, None, None))
        for number, tree in enumerate(trees[done:], done):
            if number == of_tree:                   # its rows have been led to the last level but one already
                for _ in range(level, tree.depth):
                    node = tree.down(node, x)
            margin = margin + tree.value.take(node if number == of_tree else tree.leaves(x))
        room = self.ROWS - sum(len(m) for _, m in self.held.values())
        while room < len(x) and self.held and next(iter(self.held.values()))[0] < len(trees) - 1:
            old = next(iter(self.held))             # the one that wasn't used for longest
            room += len(self.held.pop(old)[1])
            self.at.pop(old, None)
        if room >= len(x) or not self.held:
            self.held[block] = (len(trees), margin)
        else:
            self.at.pop(block, None)
        return margin

    def nodes(self, block: tuple, h: np.ndarray, x: np.ndarray, tree: Tree, number: int, level: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Per row its node at ``level`` of the growing tree (or the leaf before it), and whether the tree draws it."""
        of_tree, done, node, drawn = self.at.get(block, (None, 0, None, None))
        if of_tree != number or done > level:
            node, done, drawn = np.zeros(len(x), np.int16 if len(tree.feature) < 1 << 15 else np.int32), 0, _mixed(h, number) < share
        for _ in range(done, level):
            node = tree.down(node, x).astype(node.dtype)
        if block in self.held:
            self.at[block] = (number, level, node, drawn)
        return node, drawn


def _histograms(shared, trees: list[Tree], growing: Tree, level: int, wanted: Sequence[int], features: Sequence[int], bins: int, weight: float, share: float):
    """Over the blocks of a partition: (feature, [wanted nodes of the level, bins + 1, gradient and hessian]), in units."""
    def run(part: int, blocks):
        slots = np.full(2 ** (growing.depth + 1), -1, np.int64)
        slots[2 ** level - 1 + np.array(wanted)] = np.arange(len(wanted))
        sums, own = {f: np.zeros((len(wanted), bins + 1, 2), np.int64) for f in features}, shared.value
        for number, (y, h, x) in enumerate(blocks):
            margin = own.of((part, number), x, trees)
            node, drawn = own.nodes((part, number), h, x, growing, len(trees), level, share)
            slot = slots.take(node)
            use = np.flatnonzero((slot >= 0) & drawn)
            y, p, slot = y.take(use), 1.0 / (1.0 + np.exp(-margin.take(use))), slot.take(use) * (bins + 1)
            w = np.where(y == 1, weight, 1.0)
            both = np.rint(w * (p - y) / UNIT), np.rint(w * p * (1 - p) / UNIT)
            for f in features:
                cell = slot + x[:, f].take(use)
                for k, v in enumerate(both):
                    sums[f][:, :, k] += np.bincount(cell, v, len(wanted) * (bins + 1)).astype(np.int64).reshape(len(wanted), -1)
        return iter(sums.items())
    return run


def _splits(shared, penalty: float, least: float):
    """``_best`` as a task of its own stage."""
    def run(item):
        assert shared is not None                                   # named here, so that the worker keeps it
        return _best(item, penalty, least)
    return run


def _lighter(tree: Tree, level: int, found: list) -> list[int]:
    """Of each two children on ``level``, the one of less hessian."""
    sides, first, out = {f: (left, total) for f, *_, left, total in found}, 2 ** (level - 1) - 1, []
    for i, f in enumerate(tree.feature[first:2 * first + 1].tolist()):
        if f >= 0:
            left, total = (s[i, 1] for s in sides[f])
            out.append(2 * i + int(2 * left > total))
    return out


def _completed(summed: np.ndarray, wanted: Sequence[int], level: int, above: np.ndarray | None) -> np.ndarray:
    """The sums of all nodes of a level from those of ``wanted``: a sibling has what its parent has beyond it."""
    out = np.zeros((2 ** level, *summed.shape[1:]), np.int64)
    out[wanted] = summed
    if above is not None:
        for i, n in enumerate(wanted):
            out[n ^ 1] = above[n // 2] - summed[i]
    return out


def _best(item, penalty: float, least: float):
    """Of one feature, per node: gain, cut and none_left of its best split, the sums to its left, and the node's sums."""
    feature, sums = item[0], item[1] * UNIT
    nodes, total = np.arange(len(sums)), sums.sum(axis=1)
    inner = np.cumsum(sums[:, 1:-1], axis=1)                        # to the left of each cut, but for rows without a value
    lefts = np.stack([inner + sums[:, :1], inner], axis=2).reshape(len(sums), -1, 2)
    rights = total[:, None] - lefts
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)        # noqa: E731
    gain = score(lefts) + score(rights) - score(total)[:, None]
    gain = np.where((lefts[..., 1] >= least) & (rights[..., 1] >= least), gain, -np.inf)
    at = gain.argmax(axis=1)                                        # ties: the lowest cut, rows without a value to the left
    return feature, gain[nodes, at], at // 2 + 1, at % 2 == 0, lefts[nodes, at], total


class BoostedTrees:
    """A fitted model: the features, their bins' upper bounds and the trees."""

    def __init__(self, features: Sequence[str], cuts: dict[str, list[float]], trees: list[Tree]):
        self.features, self.cuts, self.trees = list(features), cuts, trees

    def with_probability(self, df: DataFrame, out: str = "fraud_probability", columns: Sequence[str] | None = None) -> DataFrame:
        """The probability of the positive class; null and NaN count as no value."""
        cuts, trees = [np.array(self.cuts[c]) for c in self.features], self.trees

        @F.pandas_udf("double")
        def probability(*values: pd.Series) -> pd.Series:
            binned, margin = _binned(cuts, [v.to_numpy(float) for v in values]), np.zeros(len(values[0]))
            for tree in trees:
                margin += tree.value.take(tree.leaves(binned)) if cuts else tree.value[0]
            return pd.Series(1.0 / (1.0 + np.exp(-margin)))

        values = [F.coalesce(known(df, c).cast("double"), F.lit(float("nan"))) for c in columns or self.features]
        return df.withColumn(out, probability(*(values or [F.lit(0.0)])))

    def table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows: tree, node, feature (null: a leaf), threshold (values up to it go left), none_left, value."""
        rows = []
        for t, tree in enumerate(self.trees):
            reached = [0]
            for n in reached:
                f = int(tree.feature[n])
                if f >= 0:
                    reached += [2 * n + 1, 2 * n + 2]
                    rows.append((t, n, self.features[f], float(self.cuts[self.features[f]][tree.cut[n] - 1]), bool(tree.none_left[n]), None))
                else:
                    rows.append((t, n, None, None, None, float(tree.value[n])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, none_left boolean, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The trees, and the features with their bins."""
        depth = self.trees[0].depth if self.trees else 0
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        (spark.createDataFrame([(i, c, self.cuts[c], depth) for i, c in enumerate(self.features)], "at int, feature string, cuts array<double>, depth int")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/features"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        described = spark.read.parquet(f"{path}/features").orderBy("at").collect()
        features, cuts = [r["feature"] for r in described], {r["feature"]: list(r["cuts"]) for r in described}
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():                # at most rounds x 2^(depth+1) rows
            tree = trees.setdefault(r["tree"], Tree(described[0]["depth"]))
            if r["feature"] is None:
                tree.value[r["node"]] = r["value"]
            else:
                tree.feature[r["node"]], tree.none_left[r["node"]] = features.index(r["feature"]), r["none_left"]
                tree.cut[r["node"]] = cuts[r["feature"]].index(r["threshold"]) + 1
        return cls(features, cuts, [trees[t] for t in sorted(trees)])


def fit_boosted_trees(train: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, rate: float, weight: float = 1.0,
                      rows_share: float = 1.0, columns_share: float = 1.0, seed: int = 42, penalty: float = LAMBDA, least: float = MIN_CHILD,
                      bins: int = BINS, block_rows: int = BLOCK_ROWS) -> BoostedTrees:
    """Fit ``rounds`` trees of ``depth``. ``weight`` is that of the rows whose label is 1; rows without a label count as 0. A tree sees the
    rows whose hash (of all their values and the seed) and its number fall into ``rows_share``, and a draw of the columns. Equal
    gains: the first feature, its lowest cut. An empty table, or one without features, gives a model that says one half."""
    spark = train.sparkSession
    features = list(features)
    cuts = bin_cuts(train, features, bins)
    bounds = [np.array(cuts[c]) for c in features]
    values = [known(train, c).cast("double") for c in features]
    picked = train.select(F.coalesce((F.col(label) == 1).cast("double"), F.lit(0.0)).alias("y"),
                          F.xxhash64(F.lit(seed), *train.columns).alias("h"), *(v.alias(f"x{k}") for k, v in enumerate(values)))
    wide = len(features)
    stored = materialised(picked.mapInArrow(_to_blocks(bounds, block_rows), "y binary, h binary, x binary"), "binned")
    sc = spark.sparkContext
    count = stored.count()
    parts = max(1, min(sc.defaultParallelism, -(-count // PART_BLOCKS)))
    blocks = (stored.rdd.coalesce(parts).map(lambda r: (np.frombuffer(r["y"], np.uint8), np.frombuffer(r["h"], np.uint64), np.frombuffer(r["x"], np.uint8).reshape(wide, -1).T))
              .persist(StorageLevel.MEMORY_AND_DISK))
    shared, trees = sc.broadcast(Margins()), []
    rng = np.random.default_rng(seed)
    for _ in range(rounds if wide else 0):
        used = sorted(rng.choice(wide, max(1, round(columns_share * wide)), replace=False).tolist()) if columns_share < 1 else list(range(wide))
        tree, above, found = Tree(depth), None, []
        for level in range(depth):
            lighter = [0] if not level else _lighter(tree, level, found) if above else []
            few = 0 < parts * len(used) * len(lighter) * (bins + 1) * 16 <= MERGED_BYTES
            wanted = lighter if few else list(range(2 ** level))
            local = blocks.mapPartitionsWithIndex(_histograms(shared, trees, tree, level, wanted, used, bins, weight, rows_share))
            if few:
                merged: dict = {}
                for f, v in local.collect():
                    merged[f] = merged[f] + v if f in merged else v
                above = {f: _completed(merged[f], wanted, level, above and above[f]) for f in sorted(merged)}
                found = [_best(item, penalty, least) for item in above.items()]
            else:
                above = None
                found = sorted(local.reduceByKey(np.add, min(len(used), parts)).map(_splits(shared, penalty, least)).collect(), key=lambda r: r[0])
            if not _split(tree, level, found, rate, penalty, [len(b) for b in bounds]):
                break
        trees.append(tree)
    blocks.unpersist()
    return BoostedTrees(features, cuts, trees)


def _split(tree: Tree, level: int, found: list, rate: float, penalty: float, cuts: list[int]) -> bool:
    """Split the nodes of a level by the best of all features and give the children their values (a child that the next
    level splits is passed through). Whether anything was split."""
    if not found:
        return False
    gains = np.stack([np.where(cut <= cuts[f], gain, -np.inf) for f, gain, cut, *_ in found])
    best, any_split, value = gains.argmax(axis=0), False, lambda s: -rate * s[0] / (s[1] + penalty)
    for i in range(2 ** level):
        node = 2 ** level - 1 + i
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        f, _, cut, none_left, left, total = found[best[i]]
        if not level:
            tree.value[0] = value(total[0])
        if gains[best[i], i] > MIN_GAIN:
            tree.feature[node], tree.cut[node], tree.none_left[node], any_split = f, cut[i], none_left[i], True
            tree.value[2 * node + 1], tree.value[2 * node + 2] = value(left[i]), value(total[i] - left[i])
    return any_split
