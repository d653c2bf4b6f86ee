import random
import re

import pytest

from riskloom.llm.line_dedup import line_dedup, within_one_edit


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(rows, least):
    lines = [((i is None, i or 0, k), re.findall(r"[^\x20\x09-\x0D]+", x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    first = {}
    for place, w in lines:
        if len(w) >= least:
            first[tuple(w)] = min(first.get(tuple(w), place), place)
    near = {w: min(first[v] for v in first if abs(len(v) - len(w)) < 2 and (edit_distance(v, w) <= 1 if len(w) < 100 else within_one_edit(v, w))) for w in first}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        keep = [x for k, x in enumerate(t.split("\n")) if not (len(w := tuple(re.findall(r"[^\x20\x09-\x0D]+", x))) >= least and near[w] < (i is None, i or 0, k))]
        out.append((i, "\n".join(keep), len(t.split("\n")) - len(keep)))
    return sorted(out, key=str)


def rows(seed):
    r = random.Random(seed)
    line = lambda: [r.choice("abc") for _ in range(r.randint(0, 9))]
    pool = [line() for _ in range(30)]
    out = [(None, None), (None, "a b c a b c\nx"), (None, "a b c a b c"), (4, ""), (4, "\n\n"), (3, "q r s t u v"), (3, "q r s t u v"),
           (90, "z " * 30_000), (91, "z " * 29_999 + "y"), (92, "\tq r  s t\x0bu v \n")]
    for _ in range(60):
        text = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(pool))
            if w and r.random() < 0.6:
                i = r.randrange(len(w))
                w[i:i + 1] = r.choice([[], ["d"], [w[i], "e"]])
            text.append(" ".join(w))
        out.append((r.randint(-20, 40), "\n".join(text)))
    return out


@pytest.mark.parametrize("seed,limit", [(1, 500_000), (2, 0)])
def test_against_brute_force(spark, seed, limit):
    data = rows(seed)
    df = spark.createDataFrame([(*x, 5, "clash", 9) for x in data], "doc_id long, text string, no int, line string, lines_removed long").repartition(3)
    got = line_dedup(df, broadcast_rows=limit).select("doc_id", "text", "lines_removed").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(data, 5)


def test_edit_bound():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 5))] for _ in range(2))
        assert within_one_edit(a, b) == (edit_distance(a, b) <= 1)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_exact(rows, least, exact):
    """As ``brute``, and lines of ``exact`` to ``least`` words go where an earlier line is equal."""
    lines = [((i is None, i or 0, k), tuple(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    first = {}
    for place, w in lines:
        first[w] = min(first.get(w, place), place)
    long = [w for w in first if len(w) >= least]
    near = {w: min(first[v] for v in long if abs(len(v) - len(w)) < 2 and (edit_distance(v, w) <= 1 if len(w) < 100 else within_one_edit(v, w))) for w in long}
    goes = lambda w, place: len(w) >= exact and near.get(w, first[w]) < place
    out = []
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        keep = [x for k, x in enumerate(parts) if not goes(tuple(re.findall(r"[^\x20\x09-\x0D]+", x)), (i is None, i or 0, k))]
        out.append((i, "\n".join(keep) if t is not None else None, len(parts) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_short_lines_against_brute_force(spark, limit):
    data = rows(3) + [(200, "Les.\n\nq r\nLes."), (201, "q  r\nq s\n \nLes."), (202, "a b c d e"), (203, "a b c d")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = line_dedup(df, broadcast_rows=limit, exact_words=1).select("doc_id", "text", "lines_removed").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_exact(data, 5, 1)


def test_query_removes_short_lines(spark, tmp_path):
    from riskloom.llm.line_dedup import op2
    spark.createDataFrame([(1, "Les.\nmore words"), (2, "Les.\nother"), (3, "Les.\nmore words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.lines_removed for r in op2(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 2}
