"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _fmt_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    lowered = path.lower().rstrip("/")
    for ext in ("csv", "json", "orc"):
        if lowered.endswith("." + ext):
            return ext
    return "parquet"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A1: scan a table. CSV is read with a header and, when given, an explicit schema (no inference
    pass over the data). ``columns`` prunes at the scan."""
    fmt = _fmt_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", "true").option("inferSchema", "false" if schema else "true").csv(path)
    else:
        df = reader.format(fmt).load(path)
    if columns is not None:
        df = df.select(*columns)
    return df


CORRUPT = "_corrupt_record"


def read_csv_by_name(spark: SparkSession, path: str, schema: StructType | str, corrupt: str = CORRUPT) -> DataFrame:
    """A1 for CSV files whose headers drift: columns are matched by name, file by file, in whatever order a file's header has them.
    Columns that a file lacks are null, columns that the schema lacks are left out. A row with too few or too many cells, or a
    cell that isn't of its type, keeps its line in ``corrupt`` and is null besides; it is not dropped. Empty cells are null. Lines
    are records (no line breaks inside quotes).

    A file's header is its line that has the most of the schema's names among its cells, all of them different, and at least one;
    lines of a file without one are corrupt. One pass finds the headers (a row per file), one parses."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    names = [f.name for f in schema.fields]
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"))
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    hits = F.size(F.array_intersect(cells, F.array(*map(F.lit, names))))
    headers = (lines.select("_file", "value", cells.alias("_names"), hits.alias("_hits")).where((F.col("_hits") > 0) & (F.size(F.array_distinct("_names")) == F.size("_names")))
               .groupBy("_file").agg(F.max_by(F.struct("value", "_names"), F.struct("_hits", "value")).alias("_h"))
               .select("_file", F.col("_h.value").alias("_header"), F.col("_h._names").alias("_names")))
    headers = materialised(headers, "csv-headers")
    widest = headers.agg(F.max(F.size("_names"))).first()[0] or 1
    raw = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(widest))), {"mode": "PERMISSIVE", "emptyValue": "", "nullValue": ""})
    # the number of cells, with quoted separators taken out first
    count = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), ","))
    parsed = (lines.join(headers, "_file", "left").where(F.col("_header").isNull() | (F.col("value") != F.col("_header")))
              .select("value", "_names", raw.alias("_raw"), count.alias("_cells")))
    at = F.map_from_arrays("_names", F.slice(F.array(*(F.col(f"_raw.c{i}") for i in range(widest))), F.lit(1), F.size("_names")))
    texts = parsed.withColumn("_at", F.when(F.col("_cells") == F.size("_names"), at))
    cell = {f.name: F.nullif(F.col("_at")[f.name], F.lit("")) for f in schema.fields}
    typed = {f.name: cell[f.name].try_cast(f.dataType) for f in schema.fields}
    bad = F.col("_at").isNull()
    for n in names:
        bad = bad | (cell[n].isNotNull() & typed[n].isNull())
    bad = F.coalesce(bad, F.lit(True))
    return texts.select(*(F.when(~bad, typed[n]).alias(n) for n in names), F.when(bad, F.col("value")).alias(corrupt))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Iterable[str] | None = None) -> None:
    """A2: write a table; CSV gets a header and no index (Spark never writes one)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to a new Parquet table in the shared folder and read from there, for frames
    that several passes read: column pruning goes on to work, and the lineage ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """A3: a profile or report is a one-row DataFrame written as JSON (one small file)."""
    profile.coalesce(1).write.mode("overwrite").json(path)


def dataset_layout(root: str, dataset_name: str) -> dict[str, str]:
    """A4: processed / profiles / graph folders of one dataset."""
    base = f"{root.rstrip('/')}/{dataset_name}"
    return {"root": base, "processed": f"{base}/processed", "profiles": f"{base}/profiles",
            "graph": f"{base}/graph"}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """A5: fail at plan time if required columns are absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def read_edges(spark: SparkSession, source: str) -> DataFrame:
    """The edges of a folder, or of a table that ``write_bucketed_edges`` has made, pruned to the graph columns."""
    rows = spark.read.parquet(source) if "/" in source else spark.table(source)
    return rows.select("id", "ts", "user", "device", "amount")


def write_bucketed_edges(edges: DataFrame, folder: str, name: str, buckets: int = 64) -> tuple[str, str]:
    """The edges as two tables under ``folder``, bucketed and sorted by user and by device: counts per user or device, and joins on
    them with a table of as many buckets, then need no exchange of the edges. Returns the table names."""
    names = []
    for key in ("user", "device"):
        names.append(f"{name}_by_{key}")
        (edges.select("id", "ts", "user", "device", "amount").repartition(buckets, key)
         .write.mode("overwrite").option("path", f"{folder.rstrip('/')}/{names[-1]}").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(names[-1]))
    return names[0], names[1]
