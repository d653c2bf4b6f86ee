"""As-of graph history (K3-K5, A7) and the two-pass running sum behind it.

The reference scores one transaction at a time against a growing edge table. In batch, the same
answers come from row order: the order key of a row is ``(ts, id)``.

Running counts per key are computed without a window over a whole key (a hot user or a device
with a third of all rows would be one task): rows are cut into time buckets; a window over
``(key, bucket)`` ranks inside a bucket, and a prefix sum over the small per-(key, bucket) totals
adds everything earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.tables import materialised

TARGET_ROWS_PER_BUCKET = 1_000_000
COARSE = 256


def edge_rows(df: DataFrame, id_col: str = "TransactionID", ts: str = "ts", card: str = "card1",
              device: str = "device", amount: str = "TransactionAmt") -> DataFrame:
    """The edge a scored row stores: ``user_<card1>``, ``device_<device>``, amount. A missing
    card or device reads as ``unknown`` (N16)."""
    return df.select(
        F.col(id_col).alias("id"), F.col(ts).alias("ts"),
        F.concat(F.lit("user_"), F.coalesce(F.col(card).cast("string"), F.lit("unknown"))).alias("user"),
        F.concat(F.lit("device_"), F.coalesce(F.col(device), F.lit("unknown"))).alias("device"),
        F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"))


def time_buckets(df: DataFrame, ts: str = "ts", target_rows: int = TARGET_ROWS_PER_BUCKET,
                 out: str = "_bucket") -> DataFrame:
    """``df`` with its own ``bucketing``."""
    return bucketing(df, ts, target_rows, out)(df)


def bucketing(df: DataFrame, ts: str = "ts", target_rows: int = TARGET_ROWS_PER_BUCKET,
              out: str = "_bucket") -> Callable[[DataFrame], DataFrame]:
    """What adds their time bucket among those of ``df`` to any rows.

    Equi-depth time buckets: split points from quantiles of the row times (bounded sketches), applied with MLlib's ``Bucketizer`` (a JVM-side binary search). Each bucket
    holds about ``target_rows`` rows whatever the time distribution, so a key's rows in one
    ``(key, bucket)`` window stay bounded even when a hot key meets a burst. Buckets are monotone in
    time, as the running sums require; rows sharing one timestamp share a bucket."""
    from pyspark.ml.feature import Bucketizer
    # a missing time sorts first (as the windows order nulls first) and takes the lowest bucket
    t = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")).cast("double"), F.lit(-1.0e300))
    n = df.count()
    k = max(1, -(-n // target_rows))
    if k == 1:
        return lambda rows: rows.withColumn(out, F.lit(0).cast("long"))
    with_t = df.withColumn("_tmicros", t)

    def bucketizer(cuts) -> Bucketizer:
        splits = [float("-inf")] + sorted(set(c for c in cuts if c is not None)) + [float("inf")]
        return Bucketizer(splits=splits, inputCol="_tmicros", outputCol="_bk", handleInvalid="keep")

    # two levels, so that no sketch grows with the number of buckets: at most COARSE cuts over all rows, then the
    # quantiles inside each coarse bucket, sketched where its rows are (8 bytes a bucket come to the driver)
    coarse = min(k, COARSE)
    cuts = with_t.approxQuantile("_tmicros", [i / coarse for i in range(1, coarse)], 0.1 / coarse)
    if k > coarse:
        fine = -(-k // coarse)
        inner = (bucketizer(cuts).transform(with_t).groupBy("_bk")
                 .agg(F.percentile_approx("_tmicros", [i / fine for i in range(1, fine)] or [0.5], 20 * fine).alias("q")).collect())
        cuts = [*cuts, *(c for r in inner for c in r["q"] or [])]
    b = bucketizer(cuts)
    return lambda rows: b.transform(rows.withColumn("_tmicros", t)).withColumn(out, F.col("_bk").cast("long")).drop("_tmicros", "_bk")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, out: str,
                bucket: str = "_bucket", inclusive: bool = True, offset: DataFrame | None = None,
                counted: DataFrame | None = None) -> DataFrame:
    """Per-key running sum of ``weight`` in ``order``; ``bucket`` must be monotone in ``order``, and
    keys and bucket must be non-null. ``counted``: rows with the same keys, buckets and weights that are cheaper to derive
    than ``df``; the totals are taken from them.
    ``offset`` (keys + ``_off``) adds a per-key amount known from before (stream state); it joins the
    small per-(key, bucket) prefix table, not the rows."""
    part = list(keys) + [bucket]
    w_loc = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = df.withColumn("_rs_w", weight.cast("long")).withColumn("_rs_loc", F.sum("_rs_w").over(w_loc))
    tot = (loc if counted is None else counted.withColumn("_rs_w", weight.cast("long"))).groupBy(*part).agg(F.sum("_rs_w").alias("_rs_tot"))
    w_pre = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.withColumn("_rs_pre", F.coalesce(F.sum("_rs_tot").over(w_pre), F.lit(0))).drop("_rs_tot")
    if offset is not None:
        pre = (pre.join(offset, on=list(keys), how="left")
               .withColumn("_rs_pre", F.col("_rs_pre") + F.coalesce(F.col("_off"), F.lit(0))).drop("_off"))
    # plain equality keeps the window's partitioning for the join (a null-safe one would re-shuffle
    # the rows), so callers pass non-null keys and buckets
    j = loc.join(pre, on=part, how="inner")
    val = F.col("_rs_loc") + F.col("_rs_pre") - (F.lit(0) if inclusive else F.col("_rs_w"))
    return j.withColumn(out, val.cast("long")).drop("_rs_w", "_rs_loc", "_rs_pre")


def graph_history(edges: DataFrame, width_seconds: int | None = None,
                  target_rows: int = TARGET_ROWS_PER_BUCKET, prior: "GraphState | None" = None,
                  materialise: bool = True, firsts: DataFrame | None = None) -> DataFrame:
    """K3, K4, K5 counts for every edge row; ``edges`` needs ``id, ts, user, device`` and may carry
    any other columns, which pass through (no join back by id):

    * ``user_degree`` - edge rows of the user strictly before this one (feature, N10/N11)
    * ``device_degree`` - distinct users of the device first seen strictly before (feature)
    * ``user_edges_incl`` / ``device_users_incl`` - the same with this row stored (rules)

    The rows are shuffled by (device, time bucket), then by (user, time bucket); the bucket totals
    shuffle the keys once more each. ``prior`` is
    the state that earlier stream batches have left (all of it before these rows): its edge counts
    per user and distinct users per device enter as offsets, its pairs are never first again.
    The rows are written once (unless ``materialise`` is off, for callers that have done so), as the
    cut points, first rows and running sums all read them.
    """
    cols = edges.columns
    if materialise:
        edges = materialised(edges, "edges")
    if width_seconds:   # fixed-width buckets (tests, or a known uniform arrival rate)
        put = lambda df: df.withColumn("_bucket", F.coalesce(     # noqa: E731
            F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(width_seconds * 1_000_000)).cast("long"),
            F.lit(-(1 << 62))))
    else:
        put = bucketing(edges, target_rows=target_rows)
    rows = put(edges).withColumn("_tag", F.lit(0))
    # K4: first row of each (device, user) joins the rows as an event (carrying that row's bucket).
    # At an equal order key the row (tag 0) sorts before the event (tag 1), so the count at a row
    # is strictly earlier.
    if firsts is None:
        found = (rows.groupBy("device", "user").agg(F.min(F.struct("ts", "id", "_bucket")).alias("_k"))
                 .select("device", "user", F.col("_k.ts").alias("ts"), F.col("_k.id").alias("id"), F.col("_k._bucket").alias("_bucket")))
        firsts = materialised(found, "first-rows")        # the window and the totals read them
    else:
        firsts = put(firsts.select("device", "user", "ts", "id"))
    firsts = firsts.withColumn("_tag", F.lit(1))
    dev_off = user_off = None
    if prior is not None:
        firsts = firsts.join(prior.pairs.select("device", "user"), ["device", "user"], "left_anti")
        dev_off = prior.device_counts.select("device", F.col("n").alias("_off"))
        user_off = prior.user_counts.select("user", F.col("n").alias("_off"))
    merged = rows.unionByName(firsts, allowMissingColumns=True)
    dev = running_sum(merged, ["device"], ["ts", "id", "_tag"], F.col("_tag"), "device_degree", offset=dev_off)
    w = Window.partitionBy("device", "_bucket").orderBy("ts", "id", "_tag")
    dev = (dev.withColumn("_is_first", F.coalesce((F.lead("id").over(w) == F.col("id"))
                                                  & (F.lead("_tag").over(w) == 1), F.lit(False)).cast("long"))
              .where(F.col("_tag") == 0))
    # K3: rows of the user before this one
    out = running_sum(dev, ["user"], ["ts", "id"], F.lit(1), "user_degree", inclusive=False, offset=user_off,
                      counted=rows.where(F.col("device").isNotNull()))
    return out.select(*cols, "user_degree", "device_degree",
                      (F.col("user_degree") + 1).alias("user_edges_incl"),
                      (F.col("device_degree") + F.col("_is_first")).alias("device_users_incl"))


@dataclass
class GraphState:
    """What earlier batches hold of the users and devices of a batch: ``user_counts`` (user, n) edge rows per user,
    ``pairs`` (device, user) known links, ``device_counts`` (device, n) distinct users per device."""
    user_counts: DataFrame
    pairs: DataFrame
    device_counts: DataFrame


def state_increments(prior: GraphState | None, edges: DataFrame) -> GraphState:
    """What ``edges`` (user, device) add to the state: rows per user, links that are new, new links per device."""
    return link_increments(prior, edges.groupBy("user", "device").agg(F.count(F.lit(1)).alias("n")))


def link_increments(prior: GraphState | None, links: DataFrame) -> GraphState:
    """``state_increments`` from the links (user, device, ``n`` rows) of the edges."""
    pairs = links.select("device", "user")
    if prior is not None:
        pairs = pairs.join(prior.pairs.select("device", "user"), ["device", "user"], "left_anti")
    return GraphState(links.groupBy("user").agg(F.sum("n").alias("n")), pairs,
                      pairs.groupBy("device").agg(F.count(F.lit(1)).alias("n")))


def degree_snapshot(rows: DataFrame, edges: DataFrame, user: str = "user", device: str = "device",
                    by_device: DataFrame | None = None) -> DataFrame:
    """Degrees from a whole edge table attached to rows. ``user_degree`` counts edge
    rows (repeats included), ``device_degree`` distinct users (N11). Both pre-aggregated, then
    left-joined; absent -> 0. With edges read from a table bucketed by user, and as ``by_device`` from one
    bucketed by device, neither count exchanges them."""
    ud = edges.groupBy("user").agg(F.count(F.lit(1)).alias("g_user_degree"))
    dd = device_degree(by_device if by_device is not None else edges).withColumnRenamed("device_degree", "g_device_degree")
    return (rows.join(ud, rows[user] == ud["user"], "left").drop(ud["user"])
                .join(dd, rows[device] == dd["device"], "left").drop(dd["device"])
                .fillna(0, subset=["g_user_degree", "g_device_degree"]))


def user_degree(edges: DataFrame) -> DataFrame:
    """Edge rows per user."""
    return edges.groupBy("user").agg(F.count(F.lit(1)).alias("user_degree"))


def device_degree(edges: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct users per device. Exact form dedups (device, user) first (map-side combined),
    so a hot device never holds a set of users in one buffer; ``approximate`` uses HLL."""
    if approximate:
        return edges.groupBy("device").agg(F.approx_count_distinct("user").alias("device_degree"))
    return (edges.select("device", "user").distinct()
            .groupBy("device").agg(F.count(F.lit(1)).alias("device_degree")))
