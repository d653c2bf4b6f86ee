"""Structured Streaming entry points.

T2 ``daily_risk``: live per-day level counts over arriving predictions; event-time watermark, tumbling
one-day windows, state dropped once a day is closed.

T1 ``start_scoring``: arriving transactions are scored in ``foreachBatch`` with the batch operators
of ``riskloom.plans.score``. Earlier batches are kept as increments (``riskloom.streaming.state``): edge
rows per user, links, distinct users per device and the clusters' earliest-five lists. A batch reads the keys
that it touches and writes what it adds, so its cost follows the batch. Every output is keyed by batch id, so a
retried batch replaces its own output. Rows of a batch come after all stored history and keep their (ts, id)
order inside the batch; a late row therefore sees the history known when its batch arrived, as the
reference would.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import graph, reports, rollup
from riskloom.operators import history as H
from riskloom.plans import score as S
from riskloom.session import checkpoint_dir, scratch_path
from riskloom.sources.tables import materialised
from riskloom.streaming.state import Increments


def daily_risk(predictions: DataFrame, ts: str = "created_at", level: str = "risk_level",
               watermark: str = "1 day", key: str | None = None) -> DataFrame:
    """T2 plan (works on a stream or a batch): ``day``, ``level`` (lower case), ``n``. With ``key``, rows that are delivered again
    count once: inside the watermark by their key (the state of a key is dropped with it), later ones as late rows."""
    t = F.col(ts).cast("timestamp")
    rows = predictions.withColumn("_t", t).withWatermark("_t", watermark)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
    return (rows.groupBy(F.window("_t", "1 day").alias("_w"), F.lower(F.col(level)).alias("level"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format(F.col("_w.start"), "yyyy-MM-dd").alias("day"), "level", "n"))


def run_daily_risk(spark: SparkSession, stream: DataFrame, ts: str = "created_at", level: str = "risk_level",
                   watermark: str = "1 day", sink: str | None = None, checkpoint: str | None = None,
                   state_partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Run T2 to the end of the available input (``availableNow``) in update mode. Each micro-batch
    writes its updated counts under ``batch=<id>``; the current count of a (day, level) is the one
    of its newest batch. Returns that table as a batch DataFrame.

    The state is one row per open (day, level) and the input is combined per partition before the
    shuffle; ``state_partitions`` (default: the session's shuffle partitions) is fixed when a
    checkpoint is created."""
    sink = sink or scratch_path(spark, "daily-risk-sink")
    checkpoint = checkpoint or scratch_path(spark, "daily-risk-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    previous = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (daily_risk(stream, ts, level, watermark, key).writeStream.outputMode("update")
             .foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return (out.groupBy("day", "level").agg(F.max_by("n", "batch").alias("n")))


class ScoringState:
    """The stored state of T1 under ``base``: edge rows per user, links, distinct users per device, and the
    earliest-five lists of the nodes (K6); beside them the newest time of each batch. A batch looks up
    the users, devices and nodes that it touches, and writes what it adds."""

    def __init__(self, base: str):
        self.users = Increments(f"{base}/users", "user string, n long", ["user"], {"n": "sum"})
        self.pairs = Increments(f"{base}/pairs", "device string, user string", ["device", "user"], {})
        self.devices = Increments(f"{base}/devices", "device string, n long", ["device"], {"n": "sum"})
        self.lists = Increments(f"{base}/lists", graph.LISTS_SCHEMA, ["node"], {"lst": "newest"})
        self.rollup = Increments(f"{base}/rollup", rollup.SCHEMA, ["day", "level"], rollup.MERGE, buckets=1)
        self.clock = Increments(f"{base}/clock", "one int, last timestamp", ["one"], {"last": "max"}, buckets=1)

    def newest_time(self, spark: SparkSession, batch: int) -> datetime | None:
        row = self.clock.before(spark, batch).first()
        return row["last"] if row else None

    def counts(self, links: DataFrame, batch: int) -> H.GraphState:
        """The counts of the users, links and devices in ``links`` (one row per user and device)."""
        return H.GraphState(self.users.of_keys(links.select("user").distinct(), batch), self.pairs.of_keys(links.select("device", "user"), batch),
                            self.devices.of_keys(links.select("device").distinct(), batch))

    def write(self, added: H.GraphState, lists: DataFrame, last: DataFrame, batch: int) -> None:
        self.users.write(added.user_counts, batch)
        self.pairs.write(added.pairs, batch)
        self.devices.write(added.device_counts, batch)
        self.lists.write(lists, batch)
        self.clock.write(last, batch)


def _shift_after(last: datetime | None, batch: DataFrame, ts: str) -> DataFrame:
    """Order a batch after all stored history, keeping its inner (ts, id) order."""
    first = batch.agg(F.min(ts).alias("m")).first()["m"] if last is not None else None
    if last is None or first is None or first > last:
        return batch
    shift_us = (last - first) // timedelta(microseconds=1) + 1
    return batch.withColumn(ts, F.timestamp_micros(F.unix_micros(F.col(ts)) + F.lit(shift_us)))


def score_batch(batch: DataFrame, batch_id: int, out_dir: str, probability: Callable, anomaly: Callable,
                id_col: str = "TransactionID", ts: str = "ts") -> None:
    """One micro-batch of T1: look up what earlier batches hold of its users, devices and clusters, score, write this
    batch's predictions and edges, and its increments of the state. Every write is keyed by the batch id, so a
    retried batch replaces its own output."""
    spark = batch.sparkSession
    checkpoint_dir(spark)
    state = ScoringState(f"{out_dir}/state")
    # the batch is read once and its rows are stored with their own times; lookups and increments work on its links
    arrived = materialised(batch.withColumn("_arrived", F.col(ts)), "arrived")
    ordered = _shift_after(state.newest_time(spark, batch_id), arrived, ts)
    links = materialised(graph.edge_links(H.edge_rows(ordered, id_col=id_col, ts=ts)), "links")
    known = state.counts(links, batch_id)
    known = H.GraphState(*(materialised(d, "known") for d in (known.user_counts, known.pairs, known.device_counts)))
    lists = materialised(graph.grown_lists(links, lambda nodes: state.lists.of_keys(nodes, batch_id)), "cluster-lists")
    times = lists.where(F.size("lst") >= graph.CLUSTER_NODES).select(F.col("node").alias("user"), F.element_at("lst", graph.CLUSTER_NODES)["b"].alias("_tstar"))
    scored = S.score(ordered, probability, anomaly, id_col=id_col, state=known, cluster_times=lambda _: times, links=links)
    rows = scored.withColumn(ts, F.col("_arrived"))
    stored = (reports.prediction_rows(rows.withColumn("amount", F.col("TransactionAmt")), id_col=id_col, ts=ts,
                                      keep=(F.col(id_col).alias("source_id"), F.col("anomaly_score")))
              .withColumn("day", F.to_date("created_at")))
    stored.write.mode("overwrite").partitionBy("day").parquet(f"{out_dir}/predictions/batch={batch_id}")
    state.rollup.write(rollup.daily_rollup(spark.read.parquet(f"{out_dir}/predictions/batch={batch_id}")), batch_id)
    H.edge_rows(arrived, id_col=id_col, ts=ts).write.mode("overwrite").parquet(f"{out_dir}/edges/batch={batch_id}")
    state.write(H.link_increments(known, links), lists.where("changed"), links.agg(F.lit(1).alias("one"), F.max("last").alias("last")), batch_id)


def read_predictions(spark: SparkSession, out_dir: str, start=None, end=None) -> DataFrame:
    """The stored predictions of all batches (A6 rows, their ``source_id`` and ``anomaly_score``);
    a half-open time range reads only the days that it touches."""
    rows = spark.read.parquet(f"{out_dir}/predictions")
    if start is not None:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("day") <= F.to_date(F.lit(end)))
    return rows.where(reports.between(F.col("created_at"), start, end)).drop("day", "batch")


def newest_batch(spark: SparkSession, out_dir: str) -> int:
    """The last batch whose predictions are stored (-1: none)."""
    rows = spark.read.parquet(f"{out_dir}/edges").agg(F.max("batch").alias("b")).first()
    return -1 if rows["b"] is None else int(rows["b"])


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """The daily rollup of all stored predictions, for the reports of ``riskloom.operators.rollup``."""
    return ScoringState(f"{out_dir}/state").rollup.before(spark, newest_batch(spark, out_dir) + 1)


def start_scoring(stream: DataFrame, out_dir: str, probability: Callable, anomaly: Callable,
                  checkpoint: str | None = None, id_col: str = "TransactionID", ts: str = "ts",
                  available_now: bool = True):
    """Start the scoring stream; returns the StreamingQuery."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "score-ckpt")
    writer = (stream.writeStream.foreachBatch(
        lambda df, bid: score_batch(df, bid, out_dir, probability, anomaly, id_col, ts))
        .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
