import hashlib
import re

from pyspark.sql import functions as F

from riskloom.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (None, "a\x0b b"), (None, "solo"), (7, " a b"),
        (8, "é" * 50_000), (6, "é" * 50_000), (10, "x\n"), (11, "x "), (12, "x"), (1, "y"), (1, "y")]


def check(spark, tmp_path, rows, **options):
    path = str(tmp_path / "docs.parquet")
    (spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n", F.lit(1))
     .repartition(4).write.parquet(path))
    got = exact_dedup(spark, path, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    texts = {r.text_sha256 for r in got}
    assert sum(r.kept for r in got) == len(texts)                       # one row of each group stays
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups_nulls_ties_and_long_texts(spark, tmp_path):
    check(spark, tmp_path, ROWS)


def test_several_batches_of_the_state(spark, tmp_path):
    check(spark, tmp_path, ROWS, files_per_batch=1)


def test_digest_collisions_are_told_apart_by_their_bytes(spark, tmp_path):
    check(spark, tmp_path, ROWS, digest=lambda t: F.substring(F.sha2(t, 256), 1, 0))


def test_shuffled_fetch(spark, tmp_path):
    check(spark, tmp_path, ROWS, broadcast_rows=0)


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])
