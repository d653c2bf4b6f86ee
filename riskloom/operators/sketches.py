"""Stored sketches: distinct users per device (G10) and medians of appended data.

Both keep a small mergeable summary per part of the data (a day, an appended file) and merge on read, so that new data
costs a pass over itself alone. Where the reference needs exact answers the summary only says where to look: distinct
counts near the rule's threshold are counted exactly, and a median is ranked inside the one cell of a quantile grid that
holds it, for which old parts contribute the values they have there and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.features import known
from riskloom.operators.joins import fits_broadcast

LG_K = 12               # HLL: 2^12 registers, relative error about 1.6 %
NEAR = 3                # the rules ask whether a device has more than 3 users
MARGIN = 5              # sketch estimates up to NEAR + MARGIN are counted exactly
KLL_K = 400             # KLL: rank error about 0.7 % (two-sided, 99 %)
CELLS = 200             # cells of a quantile grid


def device_sketches(edges: DataFrame, part: str = "day") -> DataFrame:
    """One HLL sketch of the users per (part, device): the stored rows."""
    return edges.groupBy(part, "device").agg(F.hll_sketch_agg("user", LG_K).alias("users"))


def device_degree(sketches: DataFrame, edges: DataFrame | None = None, near: int = NEAR, margin: int = MARGIN) -> DataFrame:
    """(device, device_degree, exact): distinct users per device from the stored sketches. With ``edges``, devices whose estimate is at
    most ``near + margin`` are counted exactly; an estimate that small is off by less than the margin. Larger ones carry the
    sketch's error, a few percent."""
    merged = sketches.groupBy("device").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("estimate"))
    if edges is None:
        return merged.select("device", F.col("estimate").alias("device_degree"), F.lit(False).alias("exact"))
    small = merged.where(F.col("estimate") <= near + margin).select("device")
    exact = (edges.join(F.broadcast(small) if fits_broadcast(small) else small, "device", "left_semi").select("device", "user").distinct()
             .groupBy("device").agg(F.count(F.lit(1)).alias("n")))
    return merged.join(exact, "device", "left").select("device", F.coalesce("n", "estimate").alias("device_degree"), F.col("n").isNotNull().alias("exact"))


def quantile_grid(df: DataFrame, columns: Sequence[str], cells: int = CELLS) -> dict[str, list[float]]:
    """Cut points of each column at about equal shares of the rows, from one KLL sketch a column. Taken once, from the first data;
    any grid gives exact medians, one that fits the data reads less."""
    shares = F.array(*(F.lit(i / cells) for i in range(1, cells)))
    values = {c: known(df, c).cast("double") for c in columns}
    row = df.agg(*(F.kll_sketch_agg_double(v, KLL_K).alias(c) for c, v in values.items()), *(F.count(v).alias(f"{c} n") for c, v in values.items()))
    found = row.select(*(F.when(F.col(f"`{c} n`") > 0, F.kll_sketch_get_quantile_double(F.when(F.col(f"`{c} n`") > 0, F.col(c)), shares)).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def cell_counts(df: DataFrame, grid: dict[str, list[float]], part: str) -> DataFrame:
    """The stored rows of some new data: (part, column_name, cell, n), how many values each cell of the grid holds (at most
    ``CELLS`` + 1 rows a part and column). Cell i holds the values from cut i - 1 up to but without cut i."""
    from pyspark.ml.feature import Bucketizer
    columns = list(grid)
    out = df.select(part, *(known(df, c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    for k, c in enumerate(columns):
        if grid[c]:
            splits = [float("-inf"), *grid[c], float("inf")]
            out = Bucketizer(splits=splits, inputCol=f"v{k}", outputCol=f"c{k}", handleInvalid="keep").transform(out)
        else:
            out = out.withColumn(f"c{k}", F.lit(0.0))
    cells = out.select(part, F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"v{k}").isNotNull(), F.col(f"c{k}").cast("int")).alias("cell"))
                                                for k, c in enumerate(columns)))))
    return cells.where(F.col("cell").isNotNull()).groupBy(part, "column_name", "cell").agg(F.count(F.lit(1)).alias("n"))


def appended_medians(df: DataFrame, counts: DataFrame, grid: dict[str, list[float]]) -> dict[str, float | None]:
    """Exact medians of all parts. The stored counts of all parts name the cells that the middle ranks fall into and how many values lie
    below; the data is read for those cells alone, with their bounds as a filter that reaches the scan."""
    at: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("column_name", "cell").agg(F.sum("n").alias("n")).collect():       # cells x columns rows
        at.setdefault(r["column_name"], {})[r["cell"]] = r["n"]
    out: dict[str, float | None] = {c: None for c in grid}
    ranks, bounds = {}, {}
    for c in at:
        n = sum(at[c].values())
        wanted, below, cells = sorted({(n + 1) // 2, n // 2 + 1}), 0, []
        for cell in sorted(at[c]):
            if any(below < k <= below + at[c][cell] for k in wanted):
                cells.append((cell, below))
            below += at[c][cell]
        cuts = [float("-inf"), *grid[c], float("inf")]
        bounds[c] = (cuts[cells[0][0]], cuts[cells[-1][0] + 1])
        ranks[c] = [k - cells[0][1] for k in wanted]
    inside = None
    for c, (lo, hi) in bounds.items():
        v = known(df, c).cast("double")
        hit = v.isNotNull()
        hit = hit & (F.col(c) >= F.lit(lo)) if lo > float("-inf") else hit
        hit = hit & (F.col(c) < F.lit(hi)) if hi < float("inf") else hit
        part = df.where(hit).select(F.lit(c).alias("c"), v.alias("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        inside = part if inside is None else inside.unionByName(part)
    return out | (_ranked(inside, ranks) if ranks else {})


def _ranked(inside: DataFrame, ranks: dict[str, list[int]]) -> dict[str, float]:
    """Mean of the values at some ranks of each column among counted values."""
    from pyspark.sql import Window
    if not ranks:
        return {}
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("v"))
    pick = F.lit(False)
    for c, ks in ranks.items():
        for k in ks:
            pick = pick | ((F.col("c") == c) & (F.col("upto") - F.col("n") < k) & (F.col("upto") >= k))
    found: dict[str, list[float]] = {}
    for r in inside.withColumn("upto", upto).where(pick).collect():
        found.setdefault(r["c"], []).extend(r["v"] for k in ranks[r["c"]] if r["upto"] - r["n"] < k <= r["upto"])
    return {c: sum(v) / len(v) for c, v in found.items()}
