"""Evaluation metrics (M6-M9) as aggregates, no driver-side arrays of scores.

ROC-AUC and average precision need running sums in score order. Scores are grouped by distinct
value first (map-side combined), then the running sum uses the two-pass bucket helper, so neither
a global window over all rows nor one task per class is involved.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.history import running_sum
from riskloom.sources.tables import materialised
from riskloom.session import checkpoint_dir

SCORE_BUCKETS = 4096
BUCKET_SCORES = 10_000


def predict_class(df: DataFrame, score: str = "fraud_probability", threshold: float = 0.5,
                  out: str = "prediction") -> DataFrame:
    """M6: strictly greater than the threshold."""
    return df.withColumn(out, (F.col(score) > threshold).cast("int"))


def _by_score(df: DataFrame, label: str, score: str, buckets: int) -> DataFrame:
    """Counts per distinct score (written once), in buckets of about equally many distinct scores:
    the cut points are quantiles of the scores themselves, so crowded ranges get more buckets."""
    checkpoint_dir(df.sparkSession)
    g = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")).checkpoint()
    distinct = g.count()
    k = max(1, min(buckets, -(-distinct // BUCKET_SCORES)))
    if k == 1:
        return g.withColumn("_bucket", F.lit(0).cast("long"))
    cuts = sorted(set(g.where(F.col("s").isNotNull()).approxQuantile("s", [i / k for i in range(1, k)], 0.1 / k)))
    found = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="s", outputCol="_b", handleInvalid="keep").transform(g)
    # a null score keeps a bucket of its own, first in order
    return found.withColumn("_bucket", F.when(F.col("s").isNull(), F.lit(-1)).otherwise(F.col("_b")).cast("long")).drop("_b")


def roc_auc(df: DataFrame, label: str = "isFraud", score: str = "fraud_probability",
            buckets: int = SCORE_BUCKETS) -> DataFrame:
    """M7: rank statistic with tied scores averaged: sum over distinct scores of
    pos * (negatives below + neg / 2) / (P * N). The numerator is kept in integers (doubled)."""
    g = _by_score(df, label, score, buckets)
    r = running_sum(g, [], ["s"], F.col("neg"), "neg_upto", inclusive=False)
    return r.agg((F.sum(2 * F.col("pos") * F.col("neg_upto") + F.col("pos") * F.col("neg")).cast("double")
                  / (2.0 * F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "isFraud", score: str = "fraud_probability",
                      buckets: int = SCORE_BUCKETS) -> DataFrame:
    """M8: sum over distinct thresholds (descending) of recall step x precision; not a trapezoid."""
    g = _by_score(df, label, score, buckets).withColumn("_bucket", F.lit(buckets - 1) - F.col("_bucket")) \
        .withColumn("cnt", F.col("pos") + F.col("neg"))
    r = running_sum(g, [], [F.desc("s")], F.col("pos"), "tp", inclusive=True)
    r = running_sum(r, [], [F.desc("s")], F.col("cnt"), "all", inclusive=True)
    return r.agg((F.sum(F.col("pos") * (F.col("tp") / F.col("all"))) / F.sum("pos")).alias("average_precision"))


def classification_report(df: DataFrame, label: str = "isFraud", score: str = "fraud_probability",
                          threshold: float = 0.5) -> DataFrame:
    """M9 in long form: rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` with
    precision, recall, f1_score, support. Zero divisions give 0. One aggregate of confusion counts."""
    pred = F.col(score) > threshold
    y = F.col(label) == 1
    c = df.agg(F.count_if(y & pred).alias("tp"), F.count_if(~y & ~pred).alias("tn"),
               F.count_if(~y & pred).alias("fp"), F.count_if(y & ~pred).alias("fn"))

    def div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def f1(p, r):
        return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    s0, s1 = tn + fp, tp + fn
    tot = s0 + s1
    base = c.select(p0.alias("p0"), r0.alias("r0"), f1(p0, r0).alias("f0"), s0.alias("s0"),
                    p1.alias("p1"), r1.alias("r1"), f1(p1, r1).alias("f1"), s1.alias("s1"),
                    div(tp + tn, tot).alias("acc"), tot.alias("tot"))
    P = F.col
    def row(name, p, r, f, sup):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("double").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", P("p0"), P("r0"), P("f0"), P("s0")),
        row("1", P("p1"), P("r1"), P("f1"), P("s1")),
        row("accuracy", none, none, P("acc"), P("tot")),
        row("macro avg", (P("p0") + P("p1")) / 2, (P("r0") + P("r1")) / 2, (P("f0") + P("f1")) / 2, P("tot")),
        row("weighted avg", div(P("p0") * P("s0") + P("p1") * P("s1"), P("tot")),
            div(P("r0") * P("s0") + P("r1") * P("s1"), P("tot")),
            div(P("f0") * P("s0") + P("f1") * P("s1"), P("tot")), P("tot")))
    return base.select(F.inline(rows)).select("class", "precision", "recall", "f1_score",
                                              F.col("support").cast("long").alias("support"))


def metrics_artefact(df: DataFrame, label: str = "isFraud", score: str = "fraud_probability") -> DataFrame:
    """M6-M9 as the one row that is stored with a model: ``roc_auc``, ``pr_auc`` and ``classification_report``, a struct per class and
    average (the accuracy is a number)."""
    spark = df.sparkSession
    scored = materialised(df.select(label, score), "scored")
    found = {r["class"]: r for r in classification_report(scored, label, score).collect()}           # five rows
    one = lambda r: F.struct(*(F.lit(r[a]).cast("double").alias(b) for a, b in (                     # noqa: E731
        ("precision", "precision"), ("recall", "recall"), ("f1_score", "f1-score"), ("support", "support"))))
    report = F.struct(*(F.lit(r["f1_score"]).alias(c) if c == "accuracy" else one(r).alias(c) for c, r in found.items()))
    return spark.range(1).select(F.lit(roc_auc(scored, label, score).first()[0]).cast("double").alias("roc_auc"),
                                 F.lit(average_precision(scored, label, score).first()[0]).cast("double").alias("pr_auc"), report.alias("classification_report"))


def write_metrics(df: DataFrame, path: str, label: str = "isFraud", score: str = "fraud_probability") -> None:
    """The artefact as JSON (one small file)."""
    metrics_artefact(df, label, score).coalesce(1).write.mode("overwrite").json(path)
