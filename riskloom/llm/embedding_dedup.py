"""Near copies among embeddings by cross-polytope hashing (operator 13).

Each vector is turned by fast pseudo-random rotations (random signs and a Hadamard transform, three times
over); the axis it then lies nearest to, with its sign, is one hash (Andoni et al., 2015). Two hashes make a
bucket, several tables make the search, and each vector also enters the buckets of the axes that come next
(multiprobe). Vectors that meet in a bucket are candidate pairs; their cosine is computed in double precision.

How the work stays bounded:

* Equal vectors are one row with a weight, whatever their number.
* Where a bucket is crowded, its mean direction becomes a hub. Vectors within half of the linking angle of a hub
  are linked with each other for certain (triangle inequality): they are counted, not compared.
* A bucket is cut into blocks of bounded size; a task compares two blocks. Members of one hub are not compared.
* Pairs are not emitted. A task returns, per vector, the weight of its partners (a pair counts in the first bucket
  that its two vectors share) and one edge to the smallest vector it is connected with in the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.registry import query, saved, table
from riskloom.operators.graph import connected_components
from riskloom.operators.joins import fits_broadcast

THRESHOLD = 0.93
TABLES, PROBES = 8, 2           # buckets of a vector: one and PROBES more in each table
SEED = 20150909
BLOCK_ROWS = 4096               # vectors of a block
GROUP_ROWS = 8192               # vectors of the small buckets that a task group takes, about
CROWDED = 16                    # a bucket is crowded from so many blocks on, in the first table
HUBS = 4096                     # hubs at most
MARGIN = 1e-6                   # of an angle, for what is certain without a comparison
PAIRS = 1 << 18                 # candidate pairs that are handled at a time


def unit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, and which rows are finite and not zero."""
    x = values.astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0.0)
    ok = np.isfinite(top) & (top > 0) & np.isfinite(x).all(axis=1)
    x = np.where(ok[:, None], x, 1.0) / np.where(ok, top, 1.0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None], ok


class Rotations:
    """``tables`` pairs of rotations for vectors of ``dim`` components (padded to a power of two)."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.size = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, 2, 3, self.size))

    def turned(self, x: np.ndarray, t: int, k: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, :x.shape[1]] = x
        for signs in self.signs[t, k]:
            y *= signs
            h = 1
            while h < self.size:                                  # fast Hadamard transform
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), -1)
                h *= 2
        return y / self.size ** 1.5


def buckets(x: np.ndarray, turns: Rotations, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: the own bucket first, then those at the least further distance
    with one of the two hashes replaced by a next best axis."""
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    n, far = np.arange(len(x)), min(2 * turns.size, probes + 1)
    for t in range(tables):
        axes, costs = [], []
        for k in range(2):
            y = turns.turned(x, t, k)
            both = np.concatenate([y, -y], axis=1)
            best = np.argpartition(-both, far - 1, axis=1)[:, :far]
            value = np.take_along_axis(both, best, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            axes.append(np.take_along_axis(best, order, 1))
            value = np.take_along_axis(value, order, 1)
            costs.append((value[:, :1] - value[:, 1:]) ** 2)
        wide = 2 * turns.size
        out[:, t, 0] = axes[0][:, 0] * wide + axes[1][:, 0]
        other = np.concatenate([axes[0][:, 1:] * wide + axes[1][:, :1], axes[0][:, :1] * wide + axes[1][:, 1:]], axis=1)
        cheapest = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            out[:, t, 1 + p] = other[n, cheapest[:, p]] if p < cheapest.shape[1] else out[:, t, 0]
    return out


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _entries(tables: int, probes: int, seed: int):
    """``mapInArrow`` over (node, weight, dim, label, vec): the rows that can link, with their buckets."""
    def run(batches):
        turns = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                dim = int(dim)
                x, ok = unit(_matrix(rows.column("vec"), dim))
                rows, x = rows.filter(pa.array(ok)), x[ok]
                if dim not in turns:
                    turns[dim] = Rotations(dim, tables, seed)
                for i in range(0, len(x), BLOCK_ROWS):
                    found = buckets(x[i:i + BLOCK_ROWS], turns[dim], tables, probes).reshape(-1, tables * (1 + probes))
                    entries = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*rows.slice(i, BLOCK_ROWS).columns, entries], [*rows.schema.names, "entries"])
    return run


def _per_label(batch):
    """(label, dim, row numbers, unit vectors) of each label and length in a batch."""
    labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_numpy()
    groups: dict = {}
    for i, found in enumerate(zip(labels, dims.tolist())):
        groups.setdefault(found, []).append(i)
    for (label, dim), at in groups.items():
        at = np.array(at)
        yield label, dim, at, unit(_matrix(batch.column("vec").take(pa.array(at)), dim)[:, :dim])[0]


def _bucket_sums(crowded, schema: pa.Schema):
    """``mapInArrow``: sums of the unit vectors in each of the ``crowded`` buckets (label, dim, bucket), by batch."""
    def run(batches):
        for batch in batches:
            own = np.array(_matrix(batch.column("entries"), len(batch.column("entries")[0].values))[:, 0]) if len(batch) else np.zeros(0, np.int64)
            out = []
            for label, dim, at, x in _per_label(batch):
                for bucket in set(np.unique(own[at]).tolist()) & crowded.value.get((label, dim), set()):
                    out.append({"label": label, "dim": dim, "bucket": bucket, "total": x[own[at] == bucket].sum(axis=0).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _hub_of(hubs, half: float):
    """``mapInArrow``: the first of the label's ``hubs`` (bucket numbers, directions) within half of the linking
    angle, or -1."""
    def run(batches):
        for batch in batches:
            hub = np.full(len(batch), -1, np.int64)
            for label, dim, at, x in _per_label(batch):
                if (label, dim) in hubs.value:
                    ids, centres = hubs.value[label, dim]
                    for i in range(0, len(at), 1024):
                        near = x[i:i + 1024] @ centres.T >= math.cos(half - MARGIN)
                        hub[at[i:i + 1024]] = np.where(near.any(axis=1), ids[near.argmax(axis=1)], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hub)], [*batch.schema.names, "hub"])
    return run


def _with_hubs(found: DataFrame, shape: str, half: float, least: int) -> DataFrame:
    """``found`` with the column ``hub``. Buckets of the first table with at least ``least`` vectors are crowded; as that is at least
    1 / HUBS of all vectors, at most HUBS directions come to the driver and go out again."""
    spark = found.sparkSession
    own = found.select("label", "dim", F.col("entries")[0].alias("bucket"))
    full = own.groupBy("label", "dim", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()
    if not full:
        return found.withColumn("hub", F.lit(-1).cast("long"))
    crowded: dict = {}
    for r in full:
        crowded.setdefault((r["label"], r["dim"]), set()).add(r["bucket"])
    sums_schema = "label {}, dim int, bucket long, total array<double>".format(found.schema["label"].dataType.simpleString())
    arrow = pa.schema([("label", to_arrow_type(found.schema["label"].dataType)), ("dim", pa.int32()), ("bucket", pa.int64()), ("total", pa.list_(pa.float64()))])
    sums = found.select("label", "dim", "entries", "vec").mapInArrow(_bucket_sums(spark.sparkContext.broadcast(crowded), arrow), sums_schema)
    sums = (sums.select("label", "dim", "bucket", F.posexplode("total").alias("at", "v")).groupBy("label", "dim", "bucket", "at").agg(F.sum("v").alias("v"))
            .groupBy("label", "dim", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("total")).collect())
    size = {(r["label"], r["dim"], r["bucket"]): r["n"] for r in full}
    hubs: dict = {}
    for r in sorted(sums, key=lambda r: (-size[r["label"], r["dim"], r["bucket"]], r["bucket"])):
        hubs.setdefault((r["label"], r["dim"]), []).append((r["bucket"], r["total"]))
    hubs = {k: (np.array([b for b, _ in v], np.int64), unit(np.array([t for _, t in v], float))[0]) for k, v in hubs.items()}
    return found.mapInArrow(_hub_of(spark.sparkContext.broadcast(hubs), half), f"{shape}, entries array<bigint>, hub long")


def _smallest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node the smallest node that it is connected with by the pairs (a, b)."""
    low = np.arange(nodes)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _compare(threshold: float, wide: int):
    """``applyInArrow`` over one group: small buckets, or two blocks of a large one. Per vector the weight of the
    partners that count here, and the smallest vector it is connected with."""
    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        rows = rows.sort_by([("label", "ascending"), ("slot", "ascending"), ("bucket", "ascending"), ("node", "ascending")])
        node, weight, hub = (rows.column(c).to_numpy() for c in ("node", "weight", "hub"))
        slot, side = rows.column("slot").to_numpy(), rows.column("side").to_numpy()
        x, _ = unit(_matrix(rows.column("vec"), dim))
        entries = _matrix(rows.column("entries"), rows.column("entries")[0].values.__len__())
        label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        bucket = rows.column("bucket").to_numpy()
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (slot[1:] != slot[:-1]) | (label[1:] != label[:-1])])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(node))
        partners = np.zeros(len(node), np.int64)
        links_a, links_b = [], []

        def take(a, b, table_no, here):
            """Pairs of rows (a, b) over the threshold: those that are first met here, and not in one hub."""
            keep = (node[a] != node[b]) & ((hub[a] != hub[b]) | (hub[a] < 0))
            a, b = a[keep], b[keep]
            for k in range(0, len(a), PAIRS):
                p, q = a[k:k + PAIRS], b[k:k + PAIRS]
                first = np.ones(len(p), bool)
                for t in range(table_no + 1):
                    mine, theirs = entries[p, t * wide:(t + 1) * wide], entries[q, t * wide:(t + 1) * wide]
                    shared = (mine[:, :, None] == theirs[:, None, :]).any(axis=2)
                    if t < table_no:
                        first &= ~shared.any(axis=1)
                    else:
                        first &= np.where(shared, mine, np.iinfo(np.int64).max).min(axis=1) == here
                p, q = p[first], q[first]
                np.add.at(partners, p, weight[q])
                np.add.at(partners, q, weight[p])
                links_a.append(p)
                links_b.append(q)

        for lo, hi in zip(start[stop - start > 1], stop[stop - start > 1]):
            same = side[lo] == -1                                 # a bucket, or a block, with itself
            left = np.arange(lo, hi) if same else lo + np.flatnonzero(side[lo:hi] == 0)
            right = left if same else lo + np.flatnonzero(side[lo:hi] == 1)
            for i in range(0, len(left), 1024):
                for j in range(i if same else 0, len(right), 1024):
                    a, b = left[i:i + 1024], right[j:j + 1024]
                    at, to = np.nonzero(x[a] @ x[b].T >= threshold)
                    a, b = a[at], b[to]
                    if same and i == j:
                        a, b = a[at < to], b[at < to]
                    if len(a):
                        take(a, b, int(slot[lo]), int(bucket[lo]))
        names, at = np.unique(node, return_inverse=True)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (links_a, links_b))
        low = names[_smallest(len(names), at[a], at[b])]
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at, partners)
        linked = total > 0
        return pa.table({"node": names[linked], "partners": total[linked], "low": low[linked]})
    return run


def _vectors(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """The rows that can link: labelled, no null among the components (zero and non-finite ones go later)."""
    return rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull()))


def embedding_dedup(rows: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, seed: int = SEED,
                    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, crowded: int = CROWDED,
                    vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row. Two vectors of one label are linked when they meet
    in a bucket and their cosine is at least ``threshold`` (between 0.5 and 1).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing;
    vectors of different lengths don't link. Equal vectors are linked with each other whatever their buckets. Rows may repeat, also
    under one identifier: each counts. The component's identifier is the smallest one in it; ``kept`` rows carry it themselves. A
    null identifier links like any other and is the smallest only of components without another: such rows are kept where
    they are alone. Other columns are not read, whatever their names. An empty table gives no rows."""
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    half = math.acos(threshold) / 2
    wide = 1 + probes

    able = _vectors(rows, "vec", "label")
    copies = able.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    named = saved(copies.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")
    shape = "node long, weight long, dim int, label {}, vec {}".format(*(named.schema[c].dataType.simpleString() for c in ("label", "vec")))
    found = saved(named.select("node", "weight", "dim", "label", "vec")
                  .mapInArrow(_entries(tables, probes, seed), f"{shape}, entries array<bigint>"), "vector-buckets")
    vectors = found.count()
    hubbed = saved(_with_hubs(found, shape, half, max(crowded * block_rows, -(-vectors // HUBS))), "vectors-with-hubs")
    of_hub = hubbed.where("hub >= 0")
    hub_totals = of_hub.groupBy("label", "dim", "hub").agg(F.sum("weight").alias("hub_weight"), F.min("node").alias("hub_low"))

    # one row per bucket a vector enters; large buckets are cut into blocks, of the same hub or of none
    entered = hubbed.select("node", "weight", "dim", "label", "vec", "entries", "hub",
                            F.explode(F.expr(f"array_distinct(transform(entries, (e, i) -> named_struct('slot', CAST(i div {wide} AS int), 'bucket', e)))")).alias("e"))
    entered = entered.select("*", "e.slot", "e.bucket").drop("e")
    place = ["label", "dim", "slot", "bucket"]
    crowd = entered.groupBy(*place, "hub").agg(F.count(F.lit(1)).alias("n"))
    per_bucket = crowd.groupBy(*place).agg(F.sum("n").alias("all_n"), F.collect_list(F.struct("hub", "n")).alias("parts"))
    large = saved(per_bucket.where(F.col("all_n") > block_rows), "large-buckets")
    groups = max(1, -(-vectors * tables * wide // group_rows))

    blocks = large.select(*place, F.explode("parts").alias("p")).select(*place, "p.hub", F.ceil(F.col("p.n") / F.lit(block_rows)).cast("int").alias("blocks"))
    each = blocks.select(*place, "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = each.select(*place, F.col("hub").alias("hub2"), F.col("block").alias("block2"))
    first = (F.col("hub") < F.col("hub2")) | ((F.col("hub") == F.col("hub2")) & (F.col("block") <= F.col("block2")))
    meets = saved(each.join(other, place).where(first & ((F.col("hub") != F.col("hub2")) | (F.col("hub") < 0))), "block-pairs")
    itself = (F.col("hub") == F.col("hub2")) & (F.col("block") == F.col("block2"))
    pair = F.xxhash64(*place, "hub", "block", "hub2", "block2")
    tasks = (meets.select(*place, "hub", "block", pair.alias("task"), F.when(itself, F.lit(-1)).otherwise(F.lit(0)).alias("side"))
             .unionByName(meets.where(~itself).select(*place, F.col("hub2").alias("hub"), F.col("block2").alias("block"), pair.alias("task"), F.lit(1).alias("side"))))
    sizes = blocks.select(*place, "hub", "blocks")
    sizes, tasks = (F.broadcast(d) if fits_broadcast(meets) else d for d in (sizes, tasks))
    cut = entered.join(sizes, [*place, "hub"], "left")
    small = (cut.where("blocks IS NULL")
             .select("node", "weight", "dim", "label", "vec", "entries", "hub", "slot", "bucket", F.pmod(F.xxhash64(*place), F.lit(groups)).alias("task"), F.lit(-1).alias("side")))
    big = (cut.where("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
           .join(tasks, [*place, "hub", "block"]).select("node", "weight", "dim", "label", "vec", "entries", "hub", "slot", "bucket", "task", "side"))
    compared = saved(small.withColumn("large", F.lit(False)).unionByName(big.withColumn("large", F.lit(True)))
                     .groupBy("large", "dim", "task").applyInArrow(_compare(threshold, wide), "node long, partners long, low long"), "vector-links")

    # links: copies, partners in other buckets, members of the own hub
    partners = compared.groupBy("node").agg(F.sum("partners").alias("partners"))
    in_hub = of_hub.join(hub_totals, ["label", "dim", "hub"]).select("node", "hub_low", (F.col("hub_weight") - F.col("weight")).alias("in_hub"))
    edges = (compared.select("node", F.col("low").alias("to")).unionByName(in_hub.select("node", F.col("hub_low").alias("to"))).where("node <> to"))
    components = saved(connected_components(edges, "node", "to").select("node", F.col("component").alias("top")), "vector-classes")
    tops = components.join(named.select("node", "first_id"), "node").groupBy("top").agg(F.min("first_id").alias("top_id"))
    classes = (named.select("label", "vec", "node", "weight", "first_id").join(found.select("node"), "node").join(partners, "node", "left")
               .join(in_hub.select("node", "in_hub"), "node", "left").join(components, "node", "left").join(tops, "top", "left")
               .select("label", "vec", F.coalesce("top_id", "first_id").alias("top_id"),
                       (F.col("weight") - 1 + F.coalesce("partners", F.lit(0)) + F.coalesce("in_hub", F.lit(0))).alias("links")))
    out = rows.join(classes, ["label", "vec"], "left")
    component = F.coalesce("top_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v WHERE label IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id, least(v.vec_id, coalesce(c.low, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


@query("op13_embedding_dedup", ORACLE)
def q_embedding_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
