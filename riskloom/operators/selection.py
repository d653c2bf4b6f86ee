"""Exact order-statistic selection without a global sort or a single giant task.

Two helpers back sampling, stratified splits and exact medians:

* ``hash_cutoff`` finds, per class, the n-th smallest seeded md5 hash. It narrows a range of the
  48-bit hash prefix with 1024-bucket histograms (one grouped count per pass, at most
  1024 x classes rows come back), until the boundary bucket is small; only that bounded bucket is
  ranked with a window.
* ``exact_order_stats`` finds k-th smallest values per column: ``percentile_approx`` brackets,
  each verified with exact counts and narrowed while they shrink; the bracket's rows are grouped to
  counts of different values, and prefix sums of those counts hold the ranks. A failed verification
  keeps the wider bracket, so the answer is always exact. NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.features import known
from riskloom.session import checkpoint_dir

HASH_BITS = 48
BUCKETS = 1024
FINAL_ROWS = 50_000


def seeded_md5(key: Column, seed: int) -> Column:
    """md5 of ``<key>:<seed>`` (the same text in Spark and DuckDB)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def md5_prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_cutoff(df: DataFrame, key: str, seed: int, targets: dict, class_col: str | None = None,
                final_rows: int = FINAL_ROWS) -> DataFrame:
    """Return ``df`` with a boolean ``_selected``: per class, exactly the ``targets[class]`` rows
    with the smallest ``(md5(key:seed), key)``. ``targets`` maps class value -> count (use the key
    ``None`` when there is no class column). Rows that repeat a key are ranked one by one, so the
    counts hold for them too; a null key hashes as the text ``null``. The histogram passes read a
    checkpoint of class and hash prefix, not the rows. Where one key repeats more than ``final_rows``
    times at the cut, any of its rows fill the count: they are numbered where they lie, not sorted."""
    h = seeded_md5(F.coalesce(F.col(key).cast("string"), F.lit("null")), seed)
    work = df.withColumn("_h", h).withColumn("_p", md5_prefix(F.col("_h")))
    cls = F.col(class_col) if class_col else F.lit(None)
    checkpoint_dir(df.sparkSession)
    narrow = work.select(cls.alias("_c"), "_p").checkpoint()
    state = {c: {"lo": 0, "hi": 1 << HASH_BITS, "need": int(n), "below": 0} for c, n in targets.items()}
    active = {c for c, s in state.items() if s["need"] > 0}
    done = {}
    while active:
        conds, widths = [], {}
        for c in active:
            s = state[c]
            widths[c] = max(1, -(-(s["hi"] - s["lo"]) // BUCKETS))
            cc = F.col("_c").isNull() if c is None else (F.col("_c") == F.lit(c))
            conds.append((cc, c))
        bucket = None
        in_range = None
        for cc, c in conds:
            s = state[c]
            rng = cc & (F.col("_p") >= s["lo"]) & (F.col("_p") < s["hi"])
            b = F.floor((F.col("_p") - F.lit(s["lo"])) / F.lit(widths[c])).cast("long")
            bucket = F.when(rng, b) if bucket is None else bucket.when(rng, b)
            in_range = rng if in_range is None else (in_range | rng)
        hist = (narrow.where(in_range).groupBy("_c", bucket.alias("_b")).count().collect())
        by_class: dict = {}
        for r in hist:
            by_class.setdefault(r["_c"], []).append((r["_b"], r["count"]))
        for c in list(active):
            s = state[c]
            rows = sorted(by_class.get(c, []))
            cum = 0
            for b, cnt in rows:
                if cum + cnt >= s["need"]:
                    w = widths[c]
                    s["lo"], s["hi"] = s["lo"] + b * w, min(s["hi"], s["lo"] + (b + 1) * w)
                    s["need"] -= cum
                    if cnt <= final_rows or w == 1:
                        done[c] = dict(s) | {"tied": cnt > final_rows}
                        active.discard(c)
                    break
                cum += cnt
            else:  # fewer rows than needed: take everything
                s["lo"], s["hi"], s["need"] = 1 << HASH_BITS, 1 << HASH_BITS, 0
                done[c] = dict(s)
                active.discard(c)
    for c, s in state.items():
        if s["need"] <= 0 and c not in done:
            done[c] = {"lo": s["lo"], "hi": s["lo"], "need": 0}
    cls_w = F.col(class_col) if class_col else F.lit(None)
    below = F.lit(False)
    boundary = F.lit(False)
    tied = F.lit(False)
    for c, s in done.items():
        cc = cls_w.isNull() if c is None else (cls_w == F.lit(c))
        below = below | (cc & (F.col("_p") < s["lo"]))
        if s["need"] > 0:
            at_cut = cc & (F.col("_p") >= s["lo"]) & (F.col("_p") < s["hi"])
            boundary = boundary | at_cut
            tied = tied | at_cut if s.get("tied") else tied
    need_expr = None
    for c, s in done.items():
        cc = cls_w.isNull() if c is None else (cls_w == F.lit(c))
        need_expr = F.when(cc, F.lit(s["need"])) if need_expr is None else need_expr.when(cc, F.lit(s["need"]))
    # the boundary set is bounded by final_rows per class: rank its rows, keep the first `need`
    if not any(s["need"] > 0 for s in done.values()):
        return work.withColumn("_selected", F.coalesce(below, F.lit(False))).drop("_h", "_p")
    part = [class_col] if class_col else []
    w = Window.partitionBy(*part).orderBy("_h", key)
    at_cut, tied = F.coalesce(boundary, F.lit(False)), F.coalesce(tied, F.lit(False))
    ranked = (work.where(at_cut & ~tied).withColumn("_selected", F.row_number().over(w) <= need_expr))
    rest = work.where(~at_cut).withColumn("_selected", F.coalesce(below, F.lit(False)))
    out = rest.unionByName(ranked)
    if any(s.get("tied") for s in done.values()):
        numbered = _numbered(work.where(tied).withColumn("_class", cls_w.cast("string")))
        out = out.unionByName(numbered.withColumn("_selected", F.col("_n") <= need_expr).drop("_n", "_class"))
    return out.drop("_h", "_p")


def _numbered(rows: DataFrame) -> DataFrame:
    """``_n`` from 1 on within each ``_class``, in no particular order: the place in the partition behind the counts of the
    partitions before it (a row per class and partition). Checkpointed, so that the numbers stay."""
    fixed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    counts = fixed.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_class").alias("_c"), F.col("_part").alias("_p2"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_at"))
    here = F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p2"))
    return fixed.withColumn("_local", local).join(F.broadcast(offsets), here).withColumn("_n", F.col("_local") + F.col("_before")).drop("_part", "_at", "_c", "_p2", "_before", "_local")


MAX_BRACKET_ROWS = 2_000_000


def exact_order_stats(df: DataFrame, wanted: dict[str, Sequence[int]], accuracy: int = 10_000,
                      max_bracket: int = MAX_BRACKET_ROWS, counts: dict[str, int] | None = None) -> dict[str, dict[int, float]]:
    """For each column, the k-th smallest non-null values (1-based k) for every k asked.

    Per column a value bracket [a, b] holding all asked ranks is narrowed with ``percentile_approx``
    passes over the rows inside the current bracket and verified by exact counts after each pass
    (a failed verification keeps the previous bracket, so the answer stays exact). Once it holds at
    most ``max_bracket`` rows, or stops shrinking because few values make up most of it, its rows are
    grouped to one count per different value, and running sums over those give the ranks: however
    often a value repeats, it is one row. A bracket of one value needs no ranking at all."""
    if not wanted:
        return {}
    if counts is None:
        counts = df.agg(*[F.count(known(df, c)).alias(c) for c in wanted]).first().asDict()
    # state: column -> [lo, hi, below, inside]; None bounds mean open
    state = {c: [None, None, 0, counts[c]] for c in wanted if counts[c]}
    while True:
        active = [c for c, (lo, hi, below, inside) in state.items()
                  if inside > max_bracket and not (lo is not None and lo == hi)]
        if not active:
            break
        probes = []
        for c in active:
            lo, hi, below, inside = state[c]
            v = known(df, c).cast("double")
            cond = v.isNotNull() if lo is None else (v >= F.lit(lo)) & (v <= F.lit(hi))
            ks = [k - below for k in wanted[c]]
            delta = 3.0 / accuracy + 1.0 / inside
            plo = max(0.0, (min(ks) - 1) / inside - delta)
            phi = min(1.0, max(ks) / inside + delta)
            probes.append(F.percentile_approx(F.when(cond, v), [plo, phi], accuracy).alias(c))
        brackets = df.agg(*probes).first().asDict()
        checks = []
        for c in active:
            a, b = brackets[c]
            v = known(df, c).cast("double")
            checks += [F.count_if(v < F.lit(a)).alias(f"{c}__lt"), F.count_if(v <= F.lit(b)).alias(f"{c}__le")]
        cnt = df.agg(*checks).first().asDict()
        progressed = False
        for c in active:
            a, b = brackets[c]
            lt, le = cnt[f"{c}__lt"], cnt[f"{c}__le"]
            if lt < min(wanted[c]) and le >= max(wanted[c]) and le - lt < state[c][3]:
                state[c] = [a, b, lt, le - lt]
                progressed = True
        if not progressed:
            break
    result = {c: {} for c in wanted}
    structs = []
    for c, (lo, hi, below, inside) in state.items():
        if lo is not None and lo == hi:
            for k in wanted[c]:
                result[c][k] = lo
            continue
        v = known(df, c).cast("double")
        keep = v.isNotNull() if lo is None else (v >= F.lit(lo)) & (v <= F.lit(hi))
        structs.append(F.struct(F.lit(c).alias("_col"), F.when(keep, v).alias("_v"),
                                F.lit(below).cast("long").alias("_below")))
    if not structs:
        return result
    # one scan for all columns: each row offers its in-bracket values, one struct per column
    union = df.select(F.inline(F.array(*structs))).where(F.col("_v").isNotNull())
    counted = union.groupBy("_col", "_v", "_below").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_col").orderBy("_v")) + F.col("_below")
    pick = F.lit(False)
    for c, ks in wanted.items():
        if c in state and not result[c]:
            for k in set(ks):
                pick = pick | ((F.col("_col") == c) & (F.col("_upto") - F.col("_n") < k) & (F.col("_upto") >= k))
    rows = counted.withColumn("_upto", upto).where(pick).select("_col", "_upto", "_n", "_v").collect()
    for r in rows:
        for k in wanted[r["_col"]]:
            if r["_upto"] - r["_n"] < k <= r["_upto"]:
                result[r["_col"]][int(k)] = r["_v"]
    return result


def exact_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact medians; even counts average the two middle values."""
    if not columns:
        return {}
    counts = df.agg(*[F.count(known(df, c)).alias(c) for c in columns]).first().asDict()
    wanted = {}
    for c in columns:
        n = counts[c]
        if n:
            wanted[c] = [(n + 1) // 2] if n % 2 else [n // 2, n // 2 + 1]
    stats = exact_order_stats(df, wanted, accuracy, counts=counts)
    out = {}
    for c in columns:
        if c not in wanted:
            out[c] = None
            continue
        vals = [stats[c][k] for k in wanted[c]]
        out[c] = vals[0] if len(vals) == 1 else (vals[0] + vals[1]) / 2.0
    return out
