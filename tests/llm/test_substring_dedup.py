import hashlib
import random
import re

import pytest

from riskloom.llm.substring_dedup import substring_dedup


def brute(rows, k):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for j in range(len(w) - k + 1):
            if i is not None:
                g = tuple(w[j:j + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            m = first.get(tuple(w[j:j + k]))
            if m is not None and (i is None or m < i):
                keep[j:j + k] = [False] * k
        left = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(1)
    out = [(None, None), (5, ""), (5, "a b c d"), (5, "a b c d"), (7, "x\ta b\x0bc d é é é é\n"),
           (None, "a b c d e f"), (None, "a b c d e f"), (900, "a b c d " * 5000)]
    return out + [(r.randint(-50, 250), " ".join(r.choice("abcd") for _ in range(r.randint(0, 14)))) for _ in range(200)]


@pytest.mark.parametrize("chunk,bucket", [(200, 3000), (1 << 20, 1 << 20)])
def test_against_brute_force(spark, chunk, bucket):
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows()], "doc_id long, text string, chunk int, bucket string").repartition(4)
    got = substring_dedup(df, 4, chunk_bytes=chunk, bucket_bytes=bucket).drop("intervals").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows(), 4)


def test_intervals_are_maximal_and_text_is_kept(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d e y a b c z")], "doc_id long, text string")
    row = substring_dedup(df, 3, with_text=True).where("doc_id = 2").first()
    assert [tuple(i) for i in row.intervals] == [(1, 6), (7, 10)]
    assert row.kept_text == "x y z"


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
