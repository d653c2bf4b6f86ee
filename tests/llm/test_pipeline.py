import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases of every stage."""
    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "er", "st", "to", "in", "on"]) for _ in range(r.randint(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0 and i < 240
        words = prose(80).split()
        if bad:
            for _ in range(12):
                words.insert(r.randrange(len(words)), r.choice(["disgusting", "worthless", "pathetic"]))
        docs.append((i, " ".join(words[:40]) + "\n" + " ".join(words[40:])))
        if i < 240:
            labels.append((i, 1, int(bad)))
    line, item = prose(30), prose(40)
    base = [prose(60) for _ in range(2)]
    near = [w.split() for w in base]
    docs += [(1000, line + "\n" + prose(50)), (1001, prose(50) + "\n" + line), (1002, line.rsplit(" ", 1)[0] + " changed\n" + prose(50))]
    docs += [(1100, base[0]), (1101, " ".join([*near[0][:30], "x", "y", *near[0][30:]])), (1102, base[1])]
    docs += [(1200, prose(20) + " " + item + " " + prose(20)), (1201, prose(30) + " " + " ".join(item.split()[20:] + ["cut"] + item.split()[:20]) + " " + prose(9))]
    docs += [(None, prose(30)), (None, None), (1300, None), (1301, ""), (1302, "long " * 30_000)]
    docs += docs[-1:]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, r.choice(["en", "de", None]), f"src{(i or 0) % 5}", len(t or ""), "clash") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, no string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {"line": line, "toxic": {i for i, _, y in labels if y}}


def test_stages_take_their_cases_and_keep_the_rest(spark, folder):
    path, planted = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [sorted(((d.doc_id, d.text) for d in docs.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.saved(stage(spark, docs, path), f"test-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        seen.append(sorted(((d.doc_id, d.text) for d in docs.collect()), key=str))
    ids = [[str(i) for i, _ in rows] for rows in seen]
    gone = {str(i) for i in ids[0]} - {str(i) for i in ids[1]}
    toxic = set(map(str, planted["toxic"]))
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3
    assert ids[2] == ids[1]
    text = dict(seen[2])
    assert planted["line"] in text[1000] and planted["line"] not in text[1001] and "changed" not in text[1002]
    assert len([1 for a, b in zip(sorted(seen[1], key=str), sorted(seen[2], key=str)) if a != b]) <= 3
    assert set(ids[2]) - set(ids[3]) == {"1101"} and ids[3].count("1302") == ids[2].count("1302")
    assert set(ids[3]) - set(ids[4]) == {"1200", "1201"}


def test_run_mixes_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and all(len(r.text.split()) == r.take_tokens <= r.n_tokens for r in rows)
    assert not {r.doc_id for r in rows} & {1101, 1200, 1201, 1300, 1301}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
