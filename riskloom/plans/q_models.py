"""Query keys for metrics (M3, M6-M9), fitted models (M1, M4, M5: rows-only checks) and the full
scoring plan with models (L5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import boosting, history, metrics, models, prep
from riskloom.plans import prepare, score
from riskloom.plans.q_prep import MERGED_CTE, SPLIT_CTE, _merged, _with
from riskloom.plans.q_report import _scored_sql
from riskloom.plans.q_score import RULE_REASON_ITEMS_SQL
from riskloom.plans.registry import query
from riskloom.sources.fixtures import fixture, with_views
from riskloom.sources.tables import materialised


@query("class_weight", _with("""
SELECT CASE WHEN count(*) FILTER (WHERE isFraud = 1) = 0 THEN 1.0
            ELSE count(*) FILTER (WHERE isFraud = 0) / count(*) FILTER (WHERE isFraud = 1) END AS scale_pos_weight
FROM split WHERE split = 'train'""", MERGED_CTE, SPLIT_CTE.format(src="merged")))
def q_class_weight(spark, sf_dir):
    md = prepare.prepare_model_data(_merged(spark, sf_dir))
    return models.class_weight(md.frame.where("split = 'train'"))


ROC_SQL = """
WITH g AS (SELECT CAST(fraud_probability AS DOUBLE) AS s, count(*) FILTER (WHERE isFraud = 1) AS pos,
                  count(*) FILTER (WHERE isFraud <> 1) AS neg FROM fx_pred GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT CAST(sum(2 * pos * nb + pos * neg) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)) AS roc_auc FROM r"""


def _pred_sql(sql: str) -> str:
    base = with_views("SELECT 1", "fx_pred")
    base = base[: base.rfind("\nSELECT 1")]
    return base + ",\n" + sql.strip()[len("WITH "):]


@query("roc_auc", _pred_sql(ROC_SQL))
def q_roc_auc(spark, sf_dir):
    return metrics.roc_auc(fixture(spark, sf_dir, "fx_pred"))


@query("average_precision", _pred_sql("""
WITH g AS (SELECT CAST(fraud_probability AS DOUBLE) AS s, count(*) FILTER (WHERE isFraud = 1) AS pos, count(*) AS cnt
           FROM fx_pred GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(cnt) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS al FROM g)
SELECT sum(pos * (tp / al)) / sum(pos) AS average_precision FROM r"""))
def q_average_precision(spark, sf_dir):
    return metrics.average_precision(fixture(spark, sf_dir, "fx_pred"))


@query("classification_report", _pred_sql("""
WITH c AS (SELECT CAST(count(*) FILTER (WHERE isFraud = 1 AND fraud_probability > 0.5) AS DOUBLE) AS tp,
                  CAST(count(*) FILTER (WHERE isFraud <> 1 AND NOT fraud_probability > 0.5) AS DOUBLE) AS tn,
                  CAST(count(*) FILTER (WHERE isFraud <> 1 AND fraud_probability > 0.5) AS DOUBLE) AS fp,
                  CAST(count(*) FILTER (WHERE isFraud = 1 AND NOT fraud_probability > 0.5) AS DOUBLE) AS fn FROM fx_pred),
m AS (SELECT *, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
             tn + fp AS s0, tp + fn AS s1 FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
             CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1, s0 + s1 AS tot FROM m)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN tot = 0 THEN 0.0 ELSE (tp + tn) / tot END, CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', CASE WHEN tot = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / tot END,
                 CASE WHEN tot = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / tot END,
                 CASE WHEN tot = 0 THEN 0.0 ELSE (f0 * s0 + f1 * s1) / tot END, CAST(tot AS BIGINT) FROM f"""))
def q_classification_report(spark, sf_dir):
    return metrics.classification_report(fixture(spark, sf_dir, "fx_pred"))


@query("predict_class", _pred_sql("""
WITH p AS (SELECT 1 AS one)
SELECT transaction_id, CAST(fraud_probability > 0.5 AS INTEGER) AS prediction FROM fx_pred"""))
def q_predict_class(spark, sf_dir):
    return metrics.predict_class(fixture(spark, sf_dir, "fx_pred")).select("transaction_id", "prediction")


# ---------------------------------------------------------------- fitted models: what must hold for any fit
def _model_data(spark, sf_dir):
    md = prepare.prepare_model_data(_merged(spark, sf_dir), keep_id=True)
    return md, md.numeric + md.categorical


@query("fraud_model", _with("""
SELECT count(*) AS validation_rows, count(*) FILTER (WHERE isFraud = 1) AS fraud_rows, count(*) AS scored_rows,
       true AS probabilities_in_range, true AS metrics_in_range
FROM split WHERE split = 'validation'""", MERGED_CTE, SPLIT_CTE.format(src="merged")))
def q_fraud_model(spark, sf_dir):
    """M1 + M6-M9: fit on train, evaluate on validation; what must hold for any such model."""
    md, feats = _model_data(spark, sf_dir)
    train, valid = materialised(md.frame.where("split = 'train'"), "train"), md.frame.where("split = 'validation'")
    model = models.fit_fraud_model(train, feats)
    pred = models.predict_probability(model, valid).checkpoint()
    found = [metrics.average_precision(pred).first()[0], metrics.roc_auc(pred).first()[0],
             metrics.classification_report(pred).where("class = 'accuracy'").first()["f1_score"]]
    return pred.agg(F.count(F.lit(1)).alias("validation_rows"), F.count_if(F.col("isFraud") == 1).alias("fraud_rows"),
                    F.count("fraud_probability").alias("scored_rows"),
                    F.bool_and(F.col("fraud_probability").between(0, 1)).alias("probabilities_in_range"),
                    F.lit(all(x is not None and 0 <= x <= 1 for x in found)).alias("metrics_in_range"))


@query("isolation_forest", _with("""
SELECT TransactionID, true AS in_range, true AS full_roots, true AS contamination_met
FROM split WHERE split = 'validation'""", MERGED_CTE, SPLIT_CTE.format(src="merged")))
def q_isolation_forest(spark, sf_dir):
    """M4 + M5: fit on train, anomaly score for every validation row; scores within their range,
    every tree grown on its 256 rows, and the fitted share of training rows beyond the offset."""
    md, feats = _model_data(spark, sf_dir)
    train, valid = md.frame.where("split = 'train'"), md.frame.where("split = 'validation'")
    forest = models.fit_isolation_forest(train, feats)
    roots = set(forest.trees.loc[forest.trees["node"] == 0, "size"])
    share = forest.anomaly_score(train).agg(F.avg((F.col("anomaly_score") > 1).cast("double"))).first()[0]
    return forest.anomaly_score(valid).select(
        "TransactionID", (F.col("anomaly_score") - F.lit(forest.offset)).between(1, 2).alias("in_range"),
        F.lit(roots == {min(models.IF_MAX_SAMPLES, train.count())}).alias("full_roots"),
        F.lit(abs(share - models.IF_CONTAMINATION) < 0.005).alias("contamination_met"))


LEARN_FEATURES = ["quantity", "discount", "tax", "line"]
LEARN_WEIGHT, LEARN_RATE = 3.0, 0.25


def _level_sql(rows: str, out: str, level: int) -> str:
    """CTEs with the best split of each node: every value of every feature but the largest as a cut, rows without a value on either
    side. Gradient and hessian at a margin of zero are w(1/2 - y) and w/4, all exact in binary."""
    return f"""long{level} AS (SELECT node, f, v, g, h FROM (SELECT node, g, h, unnest([{", ".join(str(i) for i in range(len(LEARN_FEATURES)))}]) AS f,
    unnest([{", ".join(LEARN_FEATURES)}]) AS v FROM {rows}) u),
sums{level} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM long{level} GROUP BY ALL),
total{level} AS (SELECT node, sum(g) AS tg, sum(h) AS th FROM {rows} GROUP BY node),
top{level} AS (SELECT f, max(v) AS top FROM long{level} GROUP BY f),
cuts{level} AS (SELECT s.node, s.f, c.v, sum(s.g) AS g, sum(s.h) AS h FROM sums{level} s JOIN (SELECT DISTINCT f, v FROM long{level}) c ON c.f = s.f AND s.v <= c.v
    JOIN top{level} t ON t.f = c.f AND c.v < t.top GROUP BY ALL),
sides{level} AS (SELECT c.node, c.f, c.v, side.none_left, c.g + CASE WHEN none_left THEN coalesce(n.g, 0) ELSE 0 END AS lg,
    c.h + CASE WHEN none_left THEN coalesce(n.h, 0) ELSE 0 END AS lh FROM cuts{level} c LEFT JOIN sums{level} n ON n.node = c.node AND n.f = c.f AND n.v IS NULL,
    (SELECT unnest([true, false]) AS none_left) side),
gains{level} AS (SELECT s.*, t.tg, t.th, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain
    FROM sides{level} s JOIN total{level} t USING (node) WHERE lh >= 1 AND th - lh >= 1),
{out} AS (SELECT * FROM gains{level} WHERE gain > 0.000001 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v, none_left DESC) = 1)"""


def _down_sql(rows: str, best: str, out: str) -> str:
    value = f"CASE b.f {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(LEARN_FEATURES))} END"
    return f"""{out} AS (SELECT r.* REPLACE (2 * r.node + CASE WHEN {value} IS NULL THEN CASE WHEN b.none_left THEN 1 ELSE 2 END WHEN {value} <= b.v THEN 1 ELSE 2 END AS node)
    FROM {rows} r JOIN {best} b USING (node))"""


def _boosted_sql() -> str:
    base = with_views("SELECT 1", "fx_learn")
    names = f"[{', '.join(repr(c) for c in LEARN_FEATURES)}]"
    inner = "SELECT node, {n}[f + 1] AS feature, v AS threshold, none_left, CAST(NULL AS DOUBLE) AS value FROM {b}"
    return (base[: base.rfind("\nSELECT 1")] + f""",
rows0 AS (SELECT *, 0 AS node, CASE isFraud WHEN 1 THEN {LEARN_WEIGHT} * -0.5 ELSE 0.5 END::DOUBLE AS g, CASE isFraud WHEN 1 THEN {LEARN_WEIGHT} * 0.25 ELSE 0.25 END::DOUBLE AS h FROM fx_learn),
{_level_sql("rows0", "best0", 0)},
{_down_sql("rows0", "best0", "rows1")},
{_level_sql("rows1", "best1", 1)},
{_down_sql("rows1", "best1", "rows2")}
{inner.format(n=names, b="best0")} UNION ALL {inner.format(n=names, b="best1")}
UNION ALL SELECT node, NULL, NULL, NULL, round(-{LEARN_RATE} * sum(g) / (sum(h) + 1), 9) FROM (SELECT node, g, h FROM rows2
    UNION ALL SELECT node, g, h FROM rows1 WHERE node NOT IN (SELECT node FROM best1)) l GROUP BY node""")


@query("boosted_trees", _boosted_sql())
def q_boosted_trees(spark, sf_dir):
    """M1's trees: the first tree of depth 2 on all rows of fx_learn, every split and leaf value."""
    model = boosting.fit_boosted_trees(fixture(spark, sf_dir, "fx_learn"), LEARN_FEATURES, "isFraud", rounds=1, depth=2, rate=LEARN_RATE, weight=LEARN_WEIGHT)
    return model.table(spark).select("node", "feature", "threshold", "none_left", F.round("value", 9).alias("value"))


GRAPH_FEATURES = ["user_degree", "device_degree"]


def fit_serving_models(spark, sf_dir, rounds: int = models.GBT_ROUNDS):
    """M2 + M4 on the model-ready IEEE frame: the graph model sees snapshot degrees (F2) keyed on
    integer card ids, as serving does."""
    md, feats = _model_data(spark, sf_dir)
    merged = _merged(spark, sf_dir)
    edges = history.edge_rows(merged.withColumn("ts", F.lit(None).cast("timestamp")),
                              device="DeviceType").select("id", "user", "device")
    snap = history.degree_snapshot(edges.select("id", "user", "device"), edges) \
        .select(F.col("id").alias("TransactionID"), F.col("g_user_degree").cast("double").alias("user_degree"),
                F.col("g_device_degree").cast("double").alias("device_degree"))
    train = materialised(md.frame.where("split = 'train'").join(snap, "TransactionID"), "train")    # both fits read it several times
    model_feats = feats + GRAPH_FEATURES
    gbt = models.fit_fraud_model(train, model_feats, rounds=rounds, rate=models.GRAPH_GBT_RATE,
                                 pos_weight=models.GRAPH_POS_WEIGHT)
    forest = models.fit_isolation_forest(train, feats)
    return gbt, forest, model_feats, feats


@query("score_transactions", _scored_sql("""
SELECT TransactionID AS transaction_id, true AS in_range, true AS level_fits,
       '[' || concat_ws(', ', {RULE_REASON_ITEMS_SQL},
        CASE WHEN user_degree + 1 > 5 THEN '"User has high transaction frequency"' END,
        CASE WHEN device_users_incl > 3 THEN '"Device shared across multiple accounts"' END,
        CASE WHEN in_cluster THEN '"Part of suspicious transaction cluster"' END) || ']' AS rule_reasons
FROM blend""".replace("{RULE_REASON_ITEMS_SQL}", RULE_REASON_ITEMS_SQL)))
def q_score_transactions(spark, sf_dir):
    """L5 with fitted models over every transaction of fx_txn: ranges, levels, and the reasons that
    don't come from a model."""
    gbt, forest, model_feats, if_feats = fit_serving_models(spark, sf_dir)

    def probability(df):
        aligned = prep.align_features(df, model_feats, keep=df.columns, out_prefix="m_")
        return models.predict_probability_from(gbt, aligned, ["m_" + c for c in model_feats]) \
            .drop(*["m_" + c for c in model_feats])

    def anomaly(df):
        aligned = prep.align_features(df, if_feats, keep=df.columns, out_prefix="a_")
        return forest.anomaly_score(aligned, columns=["a_" + c for c in if_feats]).drop(*["a_" + c for c in if_feats])

    scored = score.scored_view(score.score(fixture(spark, sf_dir, "fx_txn"), probability, anomaly))
    level = F.when(F.col("risk_score") < 30, "Low").when(F.col("risk_score") < 70, "Medium").otherwise("High")
    by_rule = F.filter("reasons", lambda r: r != "Unusual transaction behavior detected")
    return scored.select("transaction_id",
                         (F.col("fraud_probability").between(0, 1) & F.col("risk_score").isNotNull()
                          & (F.col("anomaly_score") - F.lit(forest.offset)).between(1, 2)).alias("in_range"),
                         (F.col("risk_level") == level).alias("level_fits"), R.reasons_json(by_rule).alias("rule_reasons"))
