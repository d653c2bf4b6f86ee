"""Keyed tables that streams keep up, batch by batch, as increments.

A batch writes only what it adds: rows under its own number, dealt into buckets of the key. Reading merges the
increments of earlier batches by key (a sum, a minimum, or the newest), and a reader that knows its keys
opens their buckets alone. Every ``FOLD`` batches the newest increments are merged into one, every ``FOLD`` of
those into a larger one, and so on: a row is rewritten once per level, and the number of tables to read grows with
the logarithm of the number of batches. Which tables hold the state before a batch follows from its number alone:
a batch that is run again overwrites its own tables and reads nothing that it has written itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 8
BUCKETS = 32


def tables_before(batch: int, fold: int = FOLD) -> list[tuple[int, int]]:
    """(level, first batch) of the tables that hold the batches before ``batch``, the oldest first: the digits
    of the number in base ``fold``, each digit a run of tables of its level."""
    found, width, level, end = [], 1, 0, batch
    while end:
        digit = end // width % fold
        found += [(level, end - width * (i + 1)) for i in range(digit)]
        end -= digit * width
        width, level = width * fold, level + 1
    return sorted(found, key=lambda x: x[1])


@dataclass
class Increments:
    """One keyed table under ``path``: columns ``schema``, key columns ``keys``, and per other column how increments
    merge (``sum``, ``min``, ``max``, or ``newest`` for the value of the latest batch)."""
    path: str
    schema: str
    keys: Sequence[str]
    merge: dict[str, str]
    buckets: int = BUCKETS
    fold: int = FOLD

    def _bucket(self, named: Sequence[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(named or self.keys)), F.lit(self.buckets)).cast("int")

    def _folder(self, level: int, first: int) -> str:
        return f"{self.path}/tier={level}/since={first}"

    def _read(self, spark: SparkSession, tables: list[tuple[int, int]]) -> DataFrame:
        schema = f"{self.schema}, bucket int, tier int, since long"
        if not tables:
            return spark.createDataFrame([], schema).limit(0)            # known to be empty, also to the optimizer
        return spark.read.schema(schema).option("basePath", self.path).parquet(*(self._folder(*t) for t in tables))

    def _merged(self, rows: DataFrame) -> DataFrame:
        if not self.merge:
            return rows.select(*self.keys).distinct()
        how = {"sum": F.sum, "min": F.min, "max": F.max, "newest": lambda c: F.max_by(c, "since")}
        return rows.groupBy(*self.keys).agg(*(how[m](c).alias(c) for c, m in self.merge.items()))

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The whole state that earlier batches have left."""
        return self._merged(self._read(spark, tables_before(batch, self.fold)))

    def of_keys(self, wanted: DataFrame, batch: int) -> DataFrame:
        """The state of the keys in ``wanted`` (the key columns, distinct), as earlier batches have left it. The files of
        other buckets are not opened."""
        spark = wanted.sparkSession
        tables = tables_before(batch, self.fold)
        rows = self._read(spark, tables)
        if not tables:
            return rows.select(*self.keys, *self.merge)
        touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]               # at most ``buckets``
        rows = rows.where(F.col("bucket").isin(touched))
        return self._merged(rows.join(wanted, list(self.keys), "left_semi"))

    def write(self, rows: DataFrame, batch: int) -> None:
        """The increments of ``batch`` (one row per key), then the folds that fall due with it."""
        columns = [*self.keys, *self.merge]
        self._write(rows.select(*columns), 0, batch)
        spark, width, level = rows.sparkSession, self.fold, 1
        while (batch + 1) % width == 0:
            first = batch + 1 - width
            parts = [(level - 1, first + i * width // self.fold) for i in range(self.fold)]
            self._write(self._merged(self._read(spark, parts)).select(*columns), level, first)
            width, level = width * self.fold, level + 1

    def _write(self, rows: DataFrame, level: int, first: int) -> None:
        (rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.keys)
         .write.mode("overwrite").partitionBy("bucket").parquet(self._folder(level, first)))
