import random
import re

import pytest

from riskloom.llm.decontamination import benchmark_matches, decontaminate


def brute_tiling(a, b, k):
    """Mark the longest common run of unmarked words until none of k words is left."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sum(mb)
        ma[i:i + n] = mb[j:j + n] = [True] * n
        out.append(best)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def data(seed):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(2, 30)))) for i in range(12)] + [(50, None), (51, ""), (3, "W1 w2 w3 w4 w5 w6")]
    docs = [(None, None), (1, ""), (2, "w1 w2 w3 w4 w5 w6"), (2, "w1 w2 w3 w4 w5 w6"), (3, "k " * 20_000)]
    for i in range(60):
        t = [r.choice(v) for _ in range(r.randint(0, 40))]
        if r.random() < 0.7:                       # an item with its parts moved about
            w = words(r.choice(items)[1])
            c = r.randint(0, len(w))
            t = t[:9] + w[c:] + t[9:14] + w[:c] + t[14:]
        docs.append((100 + i, " ".join(t)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_against_brute_force(spark, block):
    docs, items = data(4)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(*x, 0.5) for x in items], "item_id long, text string, coverage double")
    got = sorted(((r.doc_id, r.item_id, r.marked_words, r.item_words) for r in benchmark_matches(d, b, block_bytes=block).collect()), key=str)
    want = []
    for i, t in docs:
        for j, u in items:
            w = words(u)
            n = brute_tiling(words(t), w, 5) if len(words(t)) < 1000 else 0
            if len(w) >= 5 and n >= 0.6 * len(w):
                want.append((i, j, n, len(w)))
    assert got == sorted(want, key=str) and want
    clean = [r.doc_id for r in decontaminate(d, b, block_bytes=block).collect()]
    dirty = {w[0] for w in want}
    assert sorted(map(str, clean)) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert benchmark_matches(one, nothing).count() == 0 and decontaminate(one, nothing).count() == 1
    assert benchmark_matches(none, item).count() == 0 and decontaminate(none, item).count() == 0
    assert benchmark_matches(one, item).first().coverage == 1.0
