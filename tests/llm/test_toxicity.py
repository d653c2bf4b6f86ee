import random
import zlib

import pytest

from riskloom.llm.toxicity import fit_toxicity, held_out, toxicity


def corpus(n=400, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "st", "to", "in", "on"]) for _ in range(r.randint(1, 4)))
    bad = ["disgusting", "worthless", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 120))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(1 + len(w) // 10):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return d, fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")), dict(labels)


def test_held_out_accuracy(spark, fitted):
    docs, model, y = fitted
    rows = toxicity(docs, model).where(held_out()).collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum((r.score >= 0.5) == (y[r.doc_id] == 1) for r in rows) / len(rows) > 0.85


def test_nulls_long_texts_repeats_and_clashing_names(spark, fitted):
    _, model, _ = fitted
    rows = [(None, None, 7.0, "x"), (1, "", 7.0, "x"), (2, "disgusting pathetic " * 20_000, 7.0, "x"), (2, "on er", 7.0, "x"), (2, "on er", 7.0, "x")]
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double, lang string"), model).collect()
    assert len(out) == 5 and out[0].score == out[1].score and out[3].score == out[4].score
    assert out[2].score > 0.5 > out[0].score


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(empty, fit_toxicity(empty, none)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    only = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity(one, fit_toxicity(one, only)).first().score == 1.0
    assert toxicity(one, fit_toxicity(one, none)).first().score == 0.0
