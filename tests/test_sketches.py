"""Stored summaries: device degrees near the threshold and medians of appended parts are exact; CSV columns by name."""

import random
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import profiling
from riskloom.operators import sketches as S
from riskloom.sources import tables
from riskloom.streaming import stream as ST


def test_device_degrees_are_exact_near_the_threshold(spark):
    rnd = random.Random(1)
    rows = [(day, f"d{k}", f"u{rnd.randrange(k + 1)}") for k in range(12) for day in range(5) for _ in range(10)]
    rows += [(day, "hub", f"v{i}") for i in range(2000) for day in (i % 5, (i + 1) % 5)]
    edges = spark.createDataFrame(rows, "day int, device string, user string")
    exact = {d: len({u for _, x, u in rows if x == d}) for _, d, _ in rows}
    got = {r["device"]: r for r in S.device_degree(S.device_sketches(edges), edges).collect()}
    assert {d for d in exact if exact[d] <= 3} <= {d for d, r in got.items() if r["exact"]}
    assert all(r["device_degree"] == exact[d] for d, r in got.items() if r["exact"])
    assert not got["hub"]["exact"] and abs(got["hub"]["device_degree"] - 2000) < 0.1 * 2000
    assert {d for d, r in got.items() if r["device_degree"] > 3} == {d for d, n in exact.items() if n > 3}
    assert S.device_degree(S.device_sketches(edges.limit(0)), edges.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [2, 20])
def test_medians_of_appended_parts(spark, cells):
    rnd = random.Random(cells)
    parts = [[rnd.gauss(0, 1) for _ in range(101)], [rnd.gauss(30, 5) for _ in range(300)], [7.0] * 50, [None, float("nan")]]    # drifts away from the grid
    rows = [(k, v, 1 + i % 2, None) for k, part in enumerate(parts) for i, v in enumerate(part)]
    df = spark.createDataFrame(rows, "part int, v double, w int, none double")
    columns = ["v", "w", "none"]
    grid = S.quantile_grid(df.where("part = 0"), columns, cells)
    counts = S.cell_counts(df.where("part = 0"), grid, "part")
    for k in range(1, 4):
        counts = counts.unionByName(S.cell_counts(df.where(F.col("part") == k), grid, "part"))
        seen = [v for part in parts[:k + 1] for v in part if v is not None and v == v]
        got = S.appended_medians(df.where(F.col("part") <= k), counts, grid)
        assert got["v"] == statistics.median(seen) and got["none"] is None
        assert got["w"] == statistics.median([w for p, _, w, _ in rows if p <= k])


def test_median_reads_one_cell(spark):
    path = tempfile.mkdtemp(prefix="rl-cell-", dir="/tmp")
    spark.range(10_000).select(F.col("id").cast("double").alias("v"), F.lit(0).alias("part")).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    grid = S.quantile_grid(df, ["v"], 100)
    read = []
    keep, S._ranked = S._ranked, lambda inside, ranks: (read.append(inside), keep(inside, ranks))[1]
    try:
        assert S.appended_medians(df, S.cell_counts(df, grid, "part"), grid) == {"v": 4999.5}
    finally:
        S._ranked = keep
    assert read[0].count() < 400
    assert "GreaterThanOrEqual(v" in read[0]._jdf.queryExecution().executedPlan().toString()


def test_csv_columns_by_name(spark):
    path = tempfile.mkdtemp(prefix="rl-csv-", dir="/tmp")
    files = {"a": "id,name,amount\n1,x,2.5\n2,\"y, z\",3\n", "b": "amount,extra,id\n4.5,q,3\n,q,4\n", "c": "id,name,amount\n5,x\n6,x,1,9\nseven,x,1\n8,x,abc\n9,,\n",
             "d": "1,2,3\n", "e": "", "f": "\"name\",\"id\"\n\"n\",10\n"}
    for name, text in files.items():
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(text)
    got = tables.read_csv_by_name(spark, path, "id long, name string, amount double")
    rows = {tuple(r)[:3] for r in got.where("_corrupt_record IS NULL").collect()}
    assert rows == {(1, "x", 2.5), (2, "y, z", 3.0), (3, None, 4.5), (4, None, None), (9, None, None), (10, "n", None)}
    assert {r["_corrupt_record"] for r in got.where("_corrupt_record IS NOT NULL").collect()} == {"5,x", "6,x,1,9", "seven,x,1", "8,x,abc", "1,2,3"}
    assert profiling.corrupt_rows(got) == 5 and profiling.corrupt_rows(got.drop("_corrupt_record")) == 0


def test_redelivered_rows_count_once(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10), "High") for i in range(40)]
    src = tempfile.mkdtemp(prefix="rl-again-", dir="/tmp")
    schema = "transaction_id long, created_at timestamp, risk_level string"
    for batch in range(4):
        part = rows[batch * 10:batch * 10 + 10]
        again = part[:3] + rows[max(0, batch * 10 - 4):batch * 10] + rows[:1]            # in the batch, from the one before, and long gone
        spark.createDataFrame(part + again, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r["day"]: r["n"] for r in ST.run_daily_risk(spark, stream, key="transaction_id").collect()}
    assert got == {f"2024-01-0{d}": 10 for d in range(1, 5)}
