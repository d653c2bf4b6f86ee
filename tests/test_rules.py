"""Rule, level, reason and rounding boundaries."""

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import prep, scoring


def test_amount_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, 1000.0, "desktop", 5), (2, 1000.01, "desktop", 5), (3, 5000.0, "desktop", 5),
                                (4, 5000.01, "desktop", 5)], "id int, TransactionAmt double, device string, addr1 int")
    got = {r["id"]: (r["rule_score"], list(r["rule_reasons"])) for r in scoring.rule_score(df).collect()}
    assert got[1] == (0, [])
    assert got[2] == (25, [R.REASON_HIGH_AMOUNT])
    assert got[3] == (25, [R.REASON_HIGH_AMOUNT])
    assert got[4] == (40, [R.REASON_VERY_HIGH_AMOUNT])


def test_device_and_address_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, "mobile", 0), (3, "unknown", 7)],
                               "id int, device string, addr1 int").withColumn("TransactionAmt", F.lit(None).cast("double"))
    got = {r["id"]: (r["rule_score"], list(r["rule_reasons"])) for r in scoring.rule_score(df).collect()}
    # a missing device reads as unknown; a null address is missing, 0 is not
    assert got[1] == (25, [R.REASON_UNKNOWN_DEVICE, R.REASON_MISSING_ADDRESS])
    assert got[2] == (5, [R.REASON_MOBILE])
    assert got[3] == (15, [R.REASON_UNKNOWN_DEVICE])
    feats = {r["id"]: r["f_has_full_address"] for r in prep.scoring_features(df).collect()}
    assert feats == {1: 0, 2: 0, 3: 1}


def test_levels_on_rounded_score(spark):
    df = spark.createDataFrame([(29.994,), (29.995,), (69.99,), (70.0,)], "s double")
    out = df.select(R.py_round(F.col("s"), 2).alias("r")).select("r", R.risk_level(F.col("r")).alias("lv")).collect()
    def lvl(x):
        x = round(x, 2)
        return "Low" if x < 30 else "Medium" if x < 70 else "High"
    assert [r["lv"] for r in out] == [lvl(x) for x in (29.994, 29.995, 69.99, 70.0)]
    assert [r["lv"] for r in out][:2] == ["Low", "Medium"]      # 29.995 is 29.99500000000000099 in binary


def test_python_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (12.5,)], "x double")
    got = [r[0] for r in df.select(R.py_round(F.col("x"), 2)).collect()]
    assert got == [round(2.675, 2), round(0.125, 2), round(1.005, 2), round(12.5, 2)]


def test_reason_order_and_json(spark):
    df = spark.createDataFrame([(6000.0, None, None, 6, 4, True, 0.9)],
                               "a double, d string, addr1 int, ue long, du long, c boolean, an double")
    r = df.select(R.reasons_json(R.all_reasons(F.col("a"), F.col("d"), F.col("addr1"), F.col("ue"), F.col("du"),
                                               F.col("c"), F.col("an")))).first()[0]
    assert r == ('["Very high transaction amount", "Unknown device", "Missing address", '
                 '"User has high transaction frequency", "Device shared across multiple accounts", '
                 '"Part of suspicious transaction cluster", "Unusual transaction behavior detected"]')


def test_account_pair_null_and_email_match(spark):
    df = spark.createDataFrame([("a", "b", None, None), (None, "b", "x", None), ("a", None, "x", "x")],
                               "o string, d string, p string, r string")
    out = df.select(prep.X.account_pair(F.col("o"), F.col("d")).alias("pair"),
                    prep.X.email_domain_match(F.col("p"), F.col("r")).alias("m")).collect()
    assert [r["pair"] for r in out] == ["a->b", None, None]
    assert [r["m"] for r in out] == [1, 0, 1]
