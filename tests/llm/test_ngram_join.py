import random
import re

import pytest

from riskloom.llm.ngram_join import ngram_join, overlapping
from riskloom.session import DROPPED


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 100 * same >= percent * len(sets[i] | sets[j])):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d) if d is not None else None
    return sorted(((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def rows(seed):
    r = random.Random(seed)
    out = [(None, None), (None, "a b c d e f"), (900, "A B c d e f"), (901, "a b c d e f"), (902, ""), (903, "x y"), (904, "X  y\n"),
           (905, "É a"), (906, "é a"), (700, "k " * 30_000), (701, "k " * 30_000 + "z")]
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(12):                                  # near copies, some of them chains
        text = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):
            out.append((r.randint(0, 600), " ".join(text)))
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
    shared = " ".join(r.choice(vocabulary) for _ in range(25))   # a passage that many documents hold
    return out + [(1000 + i, shared + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(60)]


@pytest.mark.parametrize("seed,chunk,bucket", [(1, 500, 2000), (2, 1 << 20, 1 << 22)])
def test_against_brute_force(spark, seed, chunk, bucket):
    data = rows(seed)
    df = spark.createDataFrame([(*x, 1, "clash") for x in data], "doc_id long, text string, a int, n string").repartition(3)
    got = ngram_join(df, chunk_bytes=chunk, bucket_bytes=bucket).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(data, 5, 80)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_candidates_are_dropped_by_their_prefixes_and_no_link_is(spark):
    r = random.Random(5)
    sets = {}
    for i in range(0, 120, 2):
        base = r.sample(range(400), r.randint(40, 50))
        sets[i], sets[i + 1] = set(base), set(base[r.randint(0, 3):]) | set(r.sample(range(400), r.randint(0, 4)))
    first = {i: sorted(s)[:len(s) - -(-80 * len(s) // 100) + 1] for i, s in sets.items()}
    met = {(a, b) for a in sets for b in sets if a < b and set(first[a]) & set(first[b])}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = overlapping(spark.createDataFrame([(a, len(sets[a]), b, len(sets[b])) for a, b in met], "a long, na long, b long, nb long"),
                       spark.createDataFrame([(i, len(s), first[i]) for i, s in sets.items()], "doc_id long, n long, grams array<long>"), 80)
    kept = {tuple(x) for x in kept.collect()}
    assert linked and linked <= kept and len(kept) < len(met) / 2


def test_shuffle_files_go_with_their_step(spark):
    held = lambda: {f.getName() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_")}
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = manager.getAllFiles()
    before = held()
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows(3)], "doc_id long, text string, a int, n string").repartition(3)
    was = spark.conf.get(DROPPED, None)
    out = ngram_join(df)
    blocks = manager.getAllFiles()
    assert not held() - before and spark.conf.get(DROPPED, None) == was and out.count() == df.count()
