"""Cleaning and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from riskloom.functions.features import known
from riskloom.operators import prep
from riskloom.operators.joins import BROADCAST_MAX_BYTES, COLUMN_BYTES
from riskloom.operators.profiling import categorical_columns, null_ratios_row, numeric_columns
from riskloom.operators.selection import exact_medians
from riskloom.session import checkpoint_dir

MISSING = "missing"
RARE = "rare"


def sparse_columns(ratios: dict[str, float], threshold: float = 0.85) -> list[str]:
    """E1 decision: strictly above the threshold."""
    return [c for c, r in ratios.items() if r > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.85, ratios: dict | None = None):
    """Returns (frame, dropped names)."""
    ratios = ratios if ratios is not None else null_ratios_row(df)
    dropped = sparse_columns(ratios, threshold)
    return df.drop(*dropped), dropped


def median_values(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
                  ) -> dict[str, float | None]:
    """Exact medians (N5) by default; ``accuracy`` switches to one ``percentile_approx`` pass."""
    cols = list(columns) if columns is not None else numeric_columns(df.schema)
    if accuracy:
        row = df.agg(*[F.percentile_approx(known(df, c).cast("double"), 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    return exact_medians(df, cols)


def apply_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill numeric nulls and NaN. Integral columns are widened to double first, as a filled integer column
    with a fractional median must hold it (pandas keeps such columns as float)."""
    out = []
    for f in df.schema.fields:
        c = f.name
        m = medians.get(c)
        if c in medians and m is not None:
            if isinstance(f.dataType, (DoubleType, FloatType)):
                out.append(F.coalesce(known(df, c), F.lit(m).cast(f.dataType)).alias(c))
            else:
                out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, ratios: dict | None = None,
                  accuracy: int | None = None) -> DataFrame:
    """Numeric nulls -> median; only columns that have nulls change."""
    cols = list(columns) if columns is not None else numeric_columns(df.schema)
    ratios = ratios if ratios is not None else null_ratios_row(df.select(*cols)) if cols else {}
    with_nulls = [c for c in cols if ratios.get(c, 0) > 0]
    return apply_medians(df, median_values(df, with_nulls, accuracy))


def impute_constant(df: DataFrame, columns: Sequence[str] | None = None, value: str = MISSING) -> DataFrame:
    """Categorical (string) nulls -> ``missing``."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.fillna(value, subset=cols) if cols else df


def value_shares(df: DataFrame, columns: Sequence[str], missing: str = MISSING) -> DataFrame:
    """G9 over many columns at once: (column_name, value, n, share). Nulls count as ``missing``.
    One unpivot + one grouped count (map-side combined); totals are per column non-filtered rows."""
    if not columns:
        raise ValueError("no categorical columns")
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value"))
                    for c in columns])
    long = df.select(F.inline(arr))
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.select("column_name", "value", "n", (F.col("n") / F.lit(total)).alias("share"))


def rare_value_map(train: DataFrame, columns: Sequence[str], threshold: float = 0.005) -> DataFrame:
    """E4 fit: (column_name, value, share) of values whose train share is strictly below the
    threshold (N7). Computed on train only."""
    return value_shares(train, columns).where(F.col("share") < threshold).select("column_name", "value", "share")


def frequent_values(shares: DataFrame, threshold: float = 0.005) -> dict[str, list[str]]:
    """The values of each column that are not rare: at most ``1 / threshold`` a column, so a driver
    dict is bounded."""
    out: dict[str, list[str]] = {}
    for r in shares.where(F.col("share") >= threshold).select("column_name", "value").collect():
        out.setdefault(r["column_name"], []).append(r["value"])
    return out


def apply_rare(df: DataFrame, rare_map: DataFrame, columns: Sequence[str], rare: str = RARE,
               key: str | None = None, frequent: dict[str, list[str]] | None = None) -> DataFrame:
    """E4 apply: listed values become ``rare``; a null cell stays null even if ``missing`` is rare.

    With a unique row ``key`` the frame moves through one shuffle whatever the number of columns:
    its non-null categorical cells go long form, one semi-join against the rare map marks the rare
    cells, the marks are gathered per row (at most one entry per column) and joined back by key.
    Cells that hold one of the ``frequent`` values (few per column, see ``frequent_values``) stay out
    of that shuffle: no hot value reaches the join. Without a key, one join per column."""
    if key is None:
        out = df
        for c in columns:
            m = rare_map.where(F.col("column_name") == c).select(F.col("value").alias(f"_rv_{c}"))
            out = out.join(m, out[c] == m[f"_rv_{c}"], "left") \
                     .withColumn(c, F.when(F.col(f"_rv_{c}").isNotNull(), F.lit(rare)).otherwise(F.col(c))) \
                     .drop(f"_rv_{c}")
        return out
    def cell(c: str):
        value = F.col(c).cast("string")
        common = (frequent or {}).get(c)
        return F.when(~value.isin(common), value) if common else value

    cells = df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), cell(c).alias("value")) for c in columns])))
    hits = (cells.where(F.col("value").isNotNull())
            .join(rare_map.select("column_name", "value"), ["column_name", "value"], "left_semi"))
    marks = hits.groupBy(key).agg(F.collect_set("column_name").alias("_rare_cols"))
    j = df.join(marks, key, "left")
    return j.select(*[F.when(F.coalesce(F.array_contains("_rare_cols", c), F.lit(False)), F.lit(rare))
                       .otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fit_code_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """E6 fit: (column_name, value, code) with codes 0..k-1 in sorted value order per column.
    Numbered by one distributed sort over (column_name, value) and a per-column offset, so a column
    with many distinct values is never one task."""
    from riskloom.operators.graph import number_rows
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in columns])
    distinct = train.select(F.inline(arr)).where(F.col("value").isNotNull()).distinct()
    numbered = number_rows(distinct, [F.col("column_name"), F.col("value")], "_ix")
    first = numbered.groupBy("column_name").agg(F.min("_ix").alias("_first"))
    checkpoint_dir(train.sparkSession)
    # a fitted table: materialised once (reliable checkpoint) and reused by every apply
    return (numbered.join(F.broadcast(first), "column_name")
            .select("column_name", "value", (F.col("_ix") - F.col("_first")).cast("int").alias("code"))
            .checkpoint())


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], unknown: int = -1,
                key: str | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """E6 apply: code per column; unseen values and nulls -> -1 (N8). Columns are taken in the order of their part of the fitted
    table, smallest first, as long as those parts together measure at most ``max_bytes``: a hash lookup per row each. The cells of
    all other columns move together: with a unique row ``key`` they go long form through one join with the table and come back
    as one row per key, whatever their number; without a key, one shuffled join per column."""
    columns = list(columns)
    measured = (codes.where(F.col("column_name").isin(columns)).groupBy("column_name")
                .agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 3 * COLUMN_BYTES).alias("bytes")))
    sizes = {r["column_name"]: r["bytes"] for r in measured.collect()}             # one row per column
    looked_up, total = [], 0
    for c in sorted(columns, key=lambda c: (sizes.get(c, 0), c)):
        total += sizes.get(c, 0)
        if total <= max_bytes:
            looked_up.append(c)
    out = df
    wide = [c for c in columns if c not in looked_up]
    if wide and key is not None:
        cells = df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in wide])))
        found = (cells.where(F.col("value").isNotNull()).join(codes.where(F.col("column_name").isin(wide)), ["column_name", "value"])
                 .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "code"))).alias("_codes")))
        out = df.join(found, key, "left")
        out = out.select(*[F.coalesce(F.col("_codes")[c], F.lit(unknown)).cast("double").alias(c) if c in wide else F.col(c) for c in df.columns])
        wide = []
    for c in [*looked_up, *wide]:
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"_cv_{c}"),
                                                          F.col("code").alias(f"_cc_{c}"))
        out = out.join(F.broadcast(m) if c in looked_up else m, out[c].cast("string") == m[f"_cv_{c}"], "left") \
                 .withColumn(c, F.coalesce(F.col(f"_cc_{c}"), F.lit(unknown)).cast("double")) \
                 .drop(f"_cv_{c}", f"_cc_{c}")
    return out


def clean_transactions(df: DataFrame, threshold: float = 0.85, narrow: bool = True,
                       median_accuracy: int | None = None):
    """Drop sparse (E1) -> impute median (E2) -> impute constant (E3) -> narrow types.
    Returns (frame, dropped names). One aggregate gives all null ratios."""
    ratios = null_ratios_row(df)
    kept, dropped = drop_sparse_columns(df, threshold, ratios)
    num = numeric_columns(kept.schema)
    cat = categorical_columns(kept.schema)
    with_nulls = [c for c in num if ratios.get(c, 0) > 0]
    filled = apply_medians(kept, median_values(kept, with_nulls, median_accuracy))
    filled = impute_constant(filled, [c for c in cat if kept.schema[c].dataType.typeName() == "string"])
    if narrow:
        filled = prep.narrow_types(filled)
    return filled, dropped


def model_ready(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
                keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns, then encoded categorical columns, then the target; others dropped."""
    return df.select(*keep, *[F.col(c).cast("double") for c in numeric],
                     *[F.col(c).cast("double") for c in categorical], F.col(target).cast("byte"))


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)
