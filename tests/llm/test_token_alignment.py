"""Token alignment against a plain comparison of byte ranges, with the tokenizers' own libraries."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest

from riskloom.llm import token_alignment as T

A_PATH, B_PATH = f"{T.TOKENIZERS}/{T.A_FILE}", f"{T.TOKENIZERS}/{T.B_FILE}"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def tokens(libraries, text):
    """((id, lo, hi), ...) of both sides, or None."""
    a, b = libraries
    if not text:
        return None
    alphabet = T.byte_alphabet()
    sides = []
    e = a.encode(" " + text, add_special_tokens=False)
    sides.append([(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens)])
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]])
    out = []
    for side in sides:
        if b"".join(x for _, x in side) != b" " + text.encode():
            return None
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(libraries, texts):
    found, counts = [], Counter()
    for text in texts:
        both = tokens(libraries, text)
        if both is None:
            found.append((0, 0, 0, [], ""))
            continue
        a, b = both
        links = [(x, y) for x, lo, hi in a for y, lo2, hi2 in b if lo < hi2 and lo2 < hi]
        counts.update(links)
        ends = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [(n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
            for n_a, n_b, n_groups, links, sha in found]
    return rows, counts, most


def texts_of(seed):
    rng = random.Random(seed)
    words = ["hello", "World", "naïve", "日本語", "🙂🙃", "don't", "we'll", "<|endoftext|>", "<s>", "<0x41>", "1234567", "�", "ﬁn", "résumé", "a" * 50, "𝔘𝔫", "_x_", " "]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "", ". "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    return out + ["", None, " ", "  x", "x ", "▁", "a▁b", "\r\n", "same text", "same text"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def rows_of(found):
    return [tuple(r[c] for c in COLUMNS) for r in found.orderBy("doc_id").collect()]


@pytest.mark.parametrize("limits", [{}, {"batch_chars": 40, "links": 50, "segment": 60}], ids=["one chunk", "many chunks, texts cut"])
def test_against_byte_ranges(spark, libraries, limits):
    texts = texts_of(1)
    expected, counts, most = brute(libraries, texts)
    found, pairs = T.token_alignment(frame(spark, texts), **limits)
    assert found.columns == ["doc_id", *COLUMNS]
    assert rows_of(found) == expected
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}
    assert any(r[3] == 0 for r in expected) and any(r[4] < r[3] for r in expected)


def test_a_long_text_goes_over_chunks_and_a_wrong_end_cancels_it(spark, libraries):
    long = " ".join(random.Random(2).choice(["alpha", "béta", "gamma,", "delta"]) for _ in range(3000))
    texts = [long, long + " end▁", "x" * 5000, "alpha béta"]
    expected, counts, _ = brute(libraries, [long, None, "x" * 5000, "alpha béta"])
    found, pairs = T.token_alignment(frame(spark, texts), segment=500, links=700)
    assert rows_of(found) == expected
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == counts


def test_rows_of_one_identifier_or_none_stay_apart(spark, libraries):
    texts = ["one two", "three", "one two", "four"]
    df = spark.createDataFrame([(7, texts[0], 1, "x"), (7, texts[1], 2, "y"), (None, texts[2], 3, "z"), (None, texts[3], 4, "")],
                               "doc_id long, text string, n_a int, `key` string")
    found = T.token_alignment(df)[0]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == sorted(brute(libraries, texts)[0])
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["7", "7", "None", "None"]


def test_links_are_packed_at_any_width():
    import numpy as np
    for among in (1, 1 << 16, (1 << 16) + 1):
        at = np.array([0, among - 1, 0, among // 2] * 50)
        assert (T._unpacked(T._packed(at, among)) == at).all() and T._unpacked(T._packed(at[:0], 0)).tolist() == []


def test_empty_table(spark):
    found, pairs = T.token_alignment(frame(spark, []))
    assert found.count() == 0 and pairs.count() == 0
    assert rows_of(T.token_alignment(frame(spark, [None, ""]))[0]) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_merge_ranks_are_the_files_merges(libraries):
    """What the docstring of Pair rests on: every entry alone is one token; and equal tokens over many texts."""
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        pair = T.Pair(f.read(), g.read()).load()
    a, _ = libraries
    vocabulary = json.loads(pair.files[0])["model"]["vocab"]
    assert all([t.id for t in a.model.tokenize(entry)] == [i] for entry, i in vocabulary.items())
    texts = [t for seed in range(20) for t in texts_of(seed) if t] + [f" a{chr(c)}b 1{chr(c)}{chr(c)}, {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)] == pair.encode(texts)[0]


def test_corpus_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    short = [t if t is None or len(t) < 4000 else t[:4000] for t in texts]     # the plain comparison is quadratic
    assert rows_of(T.token_alignment(frame(spark, short))[0]) == brute(libraries, short)[0]
