"""Operator 10: exact deduplication as a stateful stream, in DataFrame operations only.

A Structured Streaming aggregation keeps, per digest of the normalised text, the smallest identifier
with its content locator (file and row) and the number of rows seen. The state lives in RocksDB on
the executors' disks, is checkpointed to the shared folder, has no watermark and never expires, so
later files can be added to the same state. Rows are combined per partition before they reach the
state, so a text that makes up a third of the input costs one state row per task.

After the stream the state is read back as a table. A digest seen more than once is a hit: the full
bytes of every member are compared with those at the keeper's locator, and members that differ (a
digest collision) are grouped again by their bytes.

Defined results: null text counts as the empty text; null identifiers sort last; of equal rows with
the same identifier the one first in (file, row) order stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved
from riskloom.session import checkpoint_dir, scratch_path

STATE_STORE = "spark.sql.streaming.stateStore"
STATE = {f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         f"{STATE_STORE}.rocksdb.allowFAllocate": "false",      # else every state partition reserves megabytes
         f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
         f"{STATE_STORE}.rocksdb.boundedMemoryUsage": "true",
         f"{STATE_STORE}.rocksdb.maxMemoryUsageMB": "300"}


def normalised(text: str) -> Column:
    """Every run of separators becomes one space (single spaces are left as they are)."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    meta = F.col("_metadata")
    return (df.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"),
                      meta["file_path"].alias("path"), meta["row_index"].alias("row"))
            .withColumn("digest", digest(F.col("norm"))))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "path", "row")


def fold_into_state(spark: SparkSession, path: str, state: str, doc_id: str = "doc_id", text: str = "text",
                    digest: Callable[[Column], Column] = sha256, files_per_batch: int = 4096) -> DataFrame:
    """Stream the files not yet seen under ``path`` into the keyed state at ``state`` (its checkpoint
    folder) and return the state: ``digest, first, n``, written as a table beside it."""
    # a stream reads folders or patterns; this pattern names exactly ``path``
    pattern = path.rstrip("/")
    pattern = f"{pattern[:-1]}[{pattern[-1]}]"
    source = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", files_per_batch).parquet(pattern))
    kept = (_rows(source, doc_id, text, digest).groupBy("digest")
            .agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        run = (kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        table = scratch_path(spark, "dedup-state")
        (spark.read.format("statestore").load(state)
         .select(F.col("key.digest").alias("digest"), F.col("value.min").alias("first"),
                 F.col("value.count").alias("n"))
         .write.parquet(table))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(table)


def exact_dedup(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256, state: str | None = None,
                files_per_batch: int = 4096, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of the Parquet files at ``path``: ``doc_id, keep_id, group_size, kept,
    text_sha256``. The members of hits are fetched by locator: by a broadcast of 8-byte keys while
    there are at most ``broadcast_rows`` of them (counted first), else by a shuffled join."""
    checkpoint_dir(spark)
    seen = fold_into_state(spark, path, state or scratch_path(spark, "dedup-stream"), doc_id, text, digest,
                           files_per_batch)
    scan = spark.read.parquet(path)
    rows = saved(_rows(scan, doc_id, text, digest).withColumn("text_sha256", sha256(F.col("norm"))).drop("norm"),
                  "dedup-rows")
    hits = seen.where("n > 1").select("digest", "first")
    members = saved(rows.join(hits, "digest").select("digest", "doc_id", "path", "row", "first"), "dedup-members")

    # full bytes: fetch every member's content, then compare it with the keeper's
    meta = F.col("_metadata")
    located = scan.select(F.col(text).alias("text"), meta["file_path"].alias("path"), meta["row_index"].alias("row"))
    if members.count() <= broadcast_rows:
        keys = members.select(F.xxhash64("path", "row").alias("key"))
        located = (located.withColumn("key", F.xxhash64("path", "row"))
                   .join(F.broadcast(keys), "key", "left_semi").drop("key"))
    contents = saved(located.join(members, ["path", "row"])
                      .select("digest", "doc_id", "path", "row", "first", normalised("text").alias("norm")), "dedup-hits")
    is_first = (F.col("path") == F.col("first.path")) & (F.col("row") == F.col("first.row"))
    keepers = contents.where(is_first).select("digest", F.col("norm").alias("keep_norm"))
    odd = saved(contents.drop("first").join(keepers, "digest").where(F.col("norm") != F.col("keep_norm"))
                 .drop("keep_norm"), "dedup-odd")

    out = rows.join(seen, "digest")
    if odd.isEmpty():
        out = out.withColumns({"odd_first": F.lit(None).cast(seen.schema["first"].dataType),
                               "odd_n": F.lit(None).cast("long"), "n_odd": F.lit(0)})
    else:
        regrouped = odd.groupBy("digest", "norm").agg(F.min(_order()).alias("odd_first"), F.count(F.lit(1)).alias("odd_n"))
        odd_rows = odd.join(regrouped, ["digest", "norm"]).select("path", "row", "odd_first", "odd_n")
        odd_count = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_odd"))
        out = out.join(odd_count, "digest", "left").join(odd_rows, ["path", "row"], "left")
    first = F.coalesce("odd_first", "first")
    return out.select("doc_id", first["doc_id"].alias("keep_id"),
                      F.coalesce("odd_n", F.col("n") - F.coalesce("n_odd", F.lit(0))).alias("group_size"),
                      ((F.col("path") == first["path"]) & (F.col("row") == first["row"])).alias("kept"),
                      "text_sha256")


@query("op10_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
