"""Profiling (C1-C6): every statistic of a wide table comes from one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from riskloom.functions.features import known


def numeric_columns(schema: StructType) -> list[str]:
    """Numeric = numeric Spark types; booleans, strings and times are categorical."""
    return [f.name for f in schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def categorical_columns(schema: StructType) -> list[str]:
    num = set(numeric_columns(schema))
    return [f.name for f in schema.fields if f.name not in num]


def null_ratios_row(df: DataFrame) -> dict[str, float]:
    """Share of nulls (NaN counts as one) per column, one aggregate (a driver-side dict of column -> ratio)."""
    if not df.columns:
        return {}
    row = df.agg(*[F.avg(known(df, c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in df.columns}


def null_ratio(df: DataFrame, top: int | None = 20) -> DataFrame:
    """``column_name``, ``missing_ratio`` (rounded 4), ratio desc then name, top ``top``.
    Stays a DataFrame: one aggregate row unpivoted with ``stack``."""
    cols = df.columns
    agg = df.agg(*[F.avg(known(df, c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    long = agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, ratio)")
    out = long.select("column_name", F.coalesce(F.col("ratio"), F.lit(0.0)).alias("ratio")) \
              .orderBy(F.desc("ratio"), F.asc("column_name"))
    if top:
        out = out.limit(top)
    return out.select("column_name", F.round("ratio", 4).alias("missing_ratio"))


def label_rate(df: DataFrame, label: str | None = "isFraud") -> DataFrame:
    """Mean of the label, null when there is no label column."""
    if label and label in df.columns:
        return df.agg(F.avg(F.col(label).cast("double")).alias("label_rate"))
    return df.agg(F.lit(None).cast("double").alias("label_rate"))


def dataset_profile(df: DataFrame, label: str | None, dataset_name: str, dataset_role: str,
                    top: int = 20) -> DataFrame:
    """Rows, columns, label rate, numeric / categorical counts, names and the top null columns,
    as one row. Rows, label rate and all null ratios come from a single aggregate."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.avg(known(df, c).isNull().cast("double")).alias(f"_n{i}") for i, c in enumerate(cols)]
    has_label = bool(label and label in cols)
    aggs.append((F.avg(F.col(label).cast("double")) if has_label else F.lit(None).cast("double"))
                .alias("_label_rate"))
    agg = df.agg(*aggs)
    pairs = ", ".join(f"named_struct('column', '{c}', 'missing_ratio', coalesce(_n{i}, 0D))"
                      for i, c in enumerate(cols))
    top_expr = (f"slice(array_sort(array({pairs}), (a, b) -> CASE WHEN a.missing_ratio > b.missing_ratio "
                f"THEN -1 WHEN a.missing_ratio < b.missing_ratio THEN 1 WHEN a.column < b.column THEN -1 "
                f"WHEN a.column > b.column THEN 1 ELSE 0 END), 1, {top})")
    n_num = len(numeric_columns(df.schema))
    return agg.select(
        F.lit(dataset_name).alias("dataset_name"), F.lit(dataset_role).alias("dataset_role"),
        F.col("_rows").alias("rows"), F.lit(len(cols)).alias("columns"),
        F.lit(label).cast("string").alias("label_column"), F.col("_label_rate").alias("label_rate"),
        F.lit(n_num).alias("numeric_columns"), F.lit(len(cols) - n_num).alias("categorical_columns"),
        F.transform(F.expr(top_expr), lambda s: F.struct(s["column"].alias("column"),
                                                          F.round(s["missing_ratio"], 4).alias("missing_ratio")))
         .alias("top_missing_columns"))


def cleaning_report(profile: DataFrame, sample_size: int, threshold: float, dropped: list[str]) -> DataFrame:
    """C4: the cleaned profile plus sample size, threshold and dropped names."""
    return profile.select("*", F.lit(int(sample_size or 0)).alias("sample_size"),
                          F.lit(float(threshold)).alias("missing_threshold"),
                          F.lit(len(dropped)).alias("dropped_column_count"),
                          F.array(*[F.lit(c) for c in dropped]).cast("array<string>").alias("dropped_columns"))


def graph_profile(profile: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts beside the profile (two count aggregates)."""
    return profile.select("*", F.lit(nodes.count()).cast("long").alias("node_count"),
                          F.lit(edges.count()).cast("long").alias("edge_count"))


def preparation_report(spark: SparkSession, prepared: DataFrame, numeric: list[str], categorical: list[str],
                       target: str, rare_map: DataFrame, source_path: str = "") -> DataFrame:
    """Split sizes and label rates (one aggregate by split), the rare-column count and the list of the
    columns with the most rare values (I3, at most 20)."""
    by_split = prepared.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.avg(F.when(F.col("split") == "train", F.col(target).cast("double"))).alias("train_fraud_rate"),
        F.avg(F.when(F.col("split") == "validation", F.col(target).cast("double"))).alias("validation_fraud_rate"))
    rare_cols = rare_map.agg(F.count_distinct("column_name")).first()[0]
    top = [F.struct(F.lit(r["column_name"]).alias("column"), F.lit(r["rare_value_count"]).cast("long").alias("rare_value_count"))
           for r in top_rare_columns(rare_map).collect()]
    listed = F.array(*top) if top else F.array().cast("array<struct<column: string, rare_value_count: bigint>>")
    return by_split.select("*", F.lit(rare_cols).cast("long").alias("rare_category_columns"), listed.alias("top_rare_category_columns")).select(
        F.lit(source_path).alias("source_path"), "train_rows", "validation_rows",
        F.lit(len(numeric) + len(categorical)).alias("feature_count"),
        F.lit(len(numeric)).alias("numeric_feature_count"),
        F.lit(len(categorical)).alias("categorical_feature_count"),
        F.lit(target).alias("target_column"), "train_fraud_rate", "validation_fraud_rate",
        "rare_category_columns", "top_rare_category_columns")


def top_rare_columns(rare_map: DataFrame, top: int = 20) -> DataFrame:
    """Columns by number of rare values, desc (ties by name), columns without rare values left out."""
    return (rare_map.groupBy("column_name").agg(F.count(F.lit(1)).alias("rare_value_count"))
            .orderBy(F.desc("rare_value_count"), "column_name").limit(top))


def corrupt_rows(df: DataFrame, corrupt: str = "_corrupt_record") -> int:
    """Rows that a scan could not read (see ``sources.tables.read_csv_by_name``); 0 without such a column."""
    return df.agg(F.count(corrupt)).first()[0] if corrupt in df.columns else 0
