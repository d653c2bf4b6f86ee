"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest

from riskloom.llm.collocations import collocations, phrase_counts

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, least=10, longest=3, top=2000):
    f, n = counted(rows, longest)
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang, w] = (score, a, f[lang, w[:k]], f[lang, w[k:]])
    out = []
    for lang in {x for x, _ in found}:
        kept = [(w, v) for (x, w), v in found.items() if x == lang and not any(
            y == lang and len(u) > len(w) and any(u[i:i + len(w)] == w for i in range(len(u))) and 100 * found[y, u][1] >= 50 * v[1] for y, u in found)]
        kept.sort(key=lambda x: (-x[1][0], -x[1][1], " ".join(x[0]).encode()))
        out += [(lang, i + 1, " ".join(w), v[1], v[2], v[3], n[lang], v[0]) for i, (w, v) in enumerate(kept[:top])]
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "dÉlta", "ÉPSILON", "zeta", "a", "b", "x y", "　", "o'neil", "--"]
    out = []
    for _ in range(docs):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ": "]) for _ in range(rng.randrange(0, 60)))
        out.append((text, rng.choice(["en", "de", None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"sample_bytes": 400, "map_bits": 16}, {"sample_bytes": 2000, "map_bits": 6, "chunk": 100}, {"sample_bytes": 0}],
                         ids=["all in the sample", "border fails", "maps full, blocks cut", "no sample"])
def test_any_sample_gives_the_exact_collocations(spark, limits):
    rows = corpus(1) + [("", "en"), (None, "de"), (" .,\n", "fr"), ("one word", "fr")]
    got = collocations(frame(spark, rows), **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(got) == brute(rows) and brute(rows)


def test_passes_follow_border_failures(spark, monkeypatch):
    from riskloom.llm import collocations as C
    names, keep = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df, name: (names.append(name), keep(df, name))[1])
    rows = corpus(2)
    for sample, passes in ((1 << 20, 1), (0, 3)):
        names.clear()
        found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in phrase_counts(frame(spark, rows), sample_bytes=sample).where("words > 0").collect()}
        assert sum("pass" in x for x in names) == passes
        assert found == {k: v for k, v in counted(rows, 3)[0].items() if v >= 10}


def test_longer_phrases_and_whole_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("abc") for _ in range(3000)) + "  " + "word" * 400 + " a b"
    rows = [(long, "en"), (long, "en"), ("a b c a b c", "en")]
    got = collocations(frame(spark, rows), min_count=12, max_words=4, chunk=256, sample_bytes=64)
    assert result(got) == brute(rows, 12, 4)


def test_top_ties_and_clashing_columns(spark):
    rows = [("m n. k l. i j", "en")] * 10
    df = frame(spark, rows).selectExpr("*", "1 AS words", "2 AS phrase", "3 AS f", "4 AS n", "5 AS rank", "6 AS _draw")
    assert result(collocations(df)) == brute(rows)
    assert [r[2] for r in result(collocations(df, top=2))] == ["i j", "k l"]
    assert result(collocations(df.drop("doc_id"))) == brute(rows)


def test_empty_table(spark):
    assert collocations(frame(spark, [])).count() == 0
    assert collocations(frame(spark, [(None, None)])).count() == 0


def test_products_beyond_64_bits():
    """The arithmetic of the score in Spark's decimals, on counts no test text can reach."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    a, l, r = 987_654_321_012, 998_877_665_544, 1_000_000_000_007
    row = spark.sql(f"""SELECT CAST((CAST(1000000 * CAST({a} AS decimal(16,0)) AS decimal(38,0)) * CAST({a} AS decimal(16,0))) div
                        (CAST({l} AS decimal(19,0)) * CAST({r} AS decimal(19,0))) AS long) AS s""").first()
    assert row["s"] == 1_000_000 * a * a // (l * r)
