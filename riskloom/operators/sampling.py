"""Sampling and splitting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.selection import hash_cutoff

MAX_CLASSES = 1000


def sample_n(df: DataFrame, n: int | None, seed: int = 42, key: str = "TransactionID",
             sort: str | None = None) -> DataFrame:
    """B1: exactly ``n`` rows chosen by seeded hash of a key, without replacement.
    ``n`` None, 0, or at least the row count keeps every row. ``sort`` re-sorts the result (a sink
    concern; left to the writer when None)."""
    if not n:
        out = df
    else:
        out = hash_cutoff(df, key, seed, {None: int(n)}).where("_selected").drop("_selected")
    if sort and sort in out.columns:
        out = out.orderBy(sort)
    return out


def sort_by_key(df: DataFrame, *columns: str) -> DataFrame:
    """I4: rows in key order, a distributed range sort; for the sinks."""
    return df.orderBy(*columns)


def class_targets(df: DataFrame, label: str, size: float) -> dict:
    """Validation rows per class: round-half-up of ``n_c * size`` (keeps label rates)."""
    found = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} values: it is no class label")
    counts = {r[label]: r["count"] for r in found}
    return {c: int(math.floor(n * size + 0.5)) for c, n in counts.items()}


def stratified_split(df: DataFrame, label: str, size: float = 0.2, seed: int = 42,
                     key: str = "TransactionID") -> DataFrame:
    """B2: adds ``split`` = ``validation`` / ``train``; per class the rows with the smallest seeded
    hashes go to validation. The per-class cut-off is found by histogram passes, so no class becomes
    one giant task."""
    targets = class_targets(df, label, size)
    marked = hash_cutoff(df, key, seed, targets, class_col=label)
    return marked.withColumn("split", F.when(F.col("_selected"), "validation").otherwise("train")) \
                 .drop("_selected")


def split_target(df: DataFrame, target: str = "isFraud", id_column: str | None = "TransactionID"):
    """Features without target and id; target cast to int8."""
    drop = [target] + ([id_column] if id_column and id_column in df.columns else [])
    return df.drop(*drop), df.select(F.col(target).cast("byte").alias(target))
