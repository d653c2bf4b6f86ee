"""Operator 3: mixing sources to target weights.

Documents stand in a tree of domain, language and source. The token budget goes down the tree by the
weights of the nodes; a node gets no more than its leaves can give (their tokens times the epochs
allowed). What a node can't take goes to its siblings, in proportion to their weights as far as they
can take more; since a node's budget is held against the capacity of its whole subtree, a shortage
reaches the siblings of an ancestor only when all nodes under that ancestor are full.

Of a leaf with T tokens and budget B every document is taken floor(B / T) times (whole epochs); the
last epoch is a prefix of B mod T tokens of the leaf's documents in the order of a seeded hash of the
epoch and the identifier, whose last document is cut. Places in that order come from sums over hash
ranges and within them, so no leaf is sorted in one task.

The domain of a document is given by an expression; by default sources are dealt into domains by the
last digit of their number. Weights default to 1 for every node.

Defined results: null language or source is a leaf of its own (empty name); rows without words, or
null text, have no tokens and are not taken; rows without an identifier are drawn by their text; rows
of one identifier stand by text, and rows equal in both are interchangeable; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved, table

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS, RANGE_ROWS = 17, 4, 512
# Fixed values of the production mixture: share of the corpus' tokens to take, and weights (others: 1).
SHARE = 0.5
WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}


def domain_of(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9])$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit("none")).otherwise((number.cast("int") % 4).cast("string")))


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def _poured(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """``budget`` of each node from that of its parent (``given``): in proportion to ``weight``, none
    above ``capacity``. Nodes that fill first (least capacity per weight) come first; the level at
    which the rest share what the full ones leave decides each node."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("fill", level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    return (nodes.withColumn("fill", F.col("capacity") / F.col("weight"))
            .withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
            .withColumn("rate", F.col("left") / F.sum("weight").over(after))
            # the first node that the rate doesn't fill, and all after it, take the rate
            .withColumn("open", F.min(F.when(F.col("rate") < F.col("fill"), F.struct("fill", level, "rate"))).over(by))
            .withColumn("budget", F.when(F.col("open").isNull() | (F.struct("fill", level) < F.struct(F.col("open.fill"), F.col(f"open.{level}"))),
                                         F.col("capacity").cast("double")).otherwise(F.col("open.rate") * F.col("weight")))
            .drop("fill", "left", "rate", "open"))


def leaf_budgets(leaves: DataFrame, tokens: float, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` (whole tokens) from ``domain, lang, source, tokens``; ``tokens`` is
    the budget of the whole mixture."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    given, keys = None, []
    for level in LEVELS:
        keys = [*keys, level]
        own = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        own = own.withColumn("given", F.lit(float(tokens))) if given is None else own.join(given, keys[:-1])
        given = _poured(own, keys[:-1], level).select(*keys, F.col("budget").alias("given"))
    # the sums are exact to a fraction of a token; whole ones are not rounded away
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, share: float = SHARE, weights: dict[str, dict[str, int]] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
                domain: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                range_rows: int = RANGE_ROWS, with_text: bool = False) -> DataFrame:
    """One row per document taken and epoch: ``doc_id, domain, lang, source, epoch, n_tokens,
    take_tokens`` (its first words) and, if asked for, those words. ``share``: of all tokens."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (domain_of(source) if domain is None else domain).alias("domain"),
                       F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                       word_count(text).alias("n_tokens"), F.md5(text).alias("tie"), F.col(text).alias("text")).where("n_tokens > 0")
    narrow = saved(rows.drop("text"), "mix-rows")
    leaves = saved(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves.select(*LEVELS, "tokens"), float(int(total * share)), weights, epochs)
    plan = saved(budgets.join(leaves.select(*LEVELS, "n"), list(LEVELS))
                 .select(*LEVELS, F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"),
                         F.ceil(F.col("n") / range_rows).alias("ranges")), "mix-plan")

    # the leaf's order in its last epoch: a hash, cut into ranges of about ``range_rows`` documents
    drawn = (narrow.join(plan, list(LEVELS)).withColumn("epoch", F.col("whole") + 1)
             .withColumn("spot", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.col("tie").cast("string")))))
             .withColumn("part", F.expr("cast(conv(substring(spot, 1, 8), 16, 10) as long) * ranges div 4294967296")))
    drawn = saved(drawn, "mix-drawn")
    prior = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(drawn.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(prior), F.lit(0)))
                   .drop("sum"), "mix-ranges")
    inside = Window.partitionBy(*LEVELS, "part").orderBy("spot", "tie").rowsBetween(Window.unboundedPreceding, -1)
    partial = (drawn.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, [*LEVELS, "part"])
               .withColumn("take", F.least("n_tokens", F.col("rest") - F.col("start") - F.col("before"))).where("take > 0")
               .select("doc_id", *LEVELS, "tie", "epoch", "n_tokens", F.col("take").alias("take_tokens")))
    full = (drawn.where("whole > 0").select("doc_id", *LEVELS, "tie", F.explode(F.sequence(F.lit(1).cast("long"), "whole")).alias("epoch"),
                                            "n_tokens", F.col("n_tokens").alias("take_tokens")))
    taken = full.unionByName(partial)
    if not with_text:
        return taken.drop("tie")
    texts = rows.select("doc_id", "tie", "text").dropDuplicates(["doc_id", "tie"])
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # a document taken whole keeps its text; of a cut one the first words stay
    cut = F.when(F.col("take_tokens") == F.col("n_tokens"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("take_tokens").cast("int")), " "))
    return (taken.withColumn("key", F.xxhash64("doc_id", "tie")).drop("tie")
            .join(texts.select(F.xxhash64("doc_id", "tie").alias("key"), "text"), "key")
            .select("doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens", cut.alias("text")))


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS.get(level, {}).items())
    return f"CAST(CASE {cases} ELSE 1 END AS DOUBLE)" if cases else "CAST(1 AS DOUBLE)"


def oracle(docs: str = "documents") -> str:
    """The same mixture in SQL, one level of the tree after the other."""
    parts = [f"""
t AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN 'dnone'
             ELSE 'd' || (CAST(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INT) % 4) END AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(text) AS tie FROM {docs}),
w AS (SELECT * FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM w GROUP BY ALL),
g0 AS (SELECT CAST(floor(sum(tokens) * {SHARE}) AS DOUBLE) AS given FROM leaf)"""]
    keys: list[str] = []
    for n, level in enumerate(LEVELS, 1):
        parents, keys = keys, [*keys, level]
        k, p = ", ".join(keys), ", ".join(parents)
        join = f"JOIN g{n - 1} USING ({p})" if parents else "CROSS JOIN g0"
        by = f"PARTITION BY {p}" if parents else ""
        parts.append(f"""
a{n} AS (SELECT {k}, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS capacity, {_sql_weight(level)} AS weight FROM leaf GROUP BY {k}),
b{n} AS (SELECT *, capacity / weight AS fill FROM a{n} {join}),
c{n} AS (SELECT *, row_number() OVER (x) AS place, (given - coalesce(sum(capacity) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
         FROM b{n} WINDOW x AS ({by} ORDER BY fill, {level})),
d{n} AS (SELECT *, min(CASE WHEN rate < fill THEN place END) OVER ({by}) AS opened FROM c{n}),
g{n} AS (SELECT {k}, CASE WHEN opened IS NULL OR place < opened THEN capacity
                     ELSE weight * max(CASE WHEN place = opened THEN rate END) OVER ({by}) END AS given FROM d{n})""")
    parts.append(f"""
plan AS (SELECT domain, lang, source, CAST(floor(given + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(given + 1e-6) AS BIGINT) % tokens AS rest
         FROM leaf JOIN g3 USING (domain, lang, source)),
o AS (SELECT w.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY w.domain, w.lang, w.source
             ORDER BY md5('{SEED}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), tie)), tie
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, whole + 1 AS epoch, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens FROM o WHERE rest > before
UNION ALL
SELECT doc_id, domain, lang, source, unnest(range(1, whole + 1)) AS epoch, n_tokens, n_tokens AS take_tokens FROM o WHERE whole > 0""")
    return "WITH" + ",".join(parts)


@query("op3_mixing", oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
