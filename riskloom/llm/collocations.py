"""Phrase collocation mining by Toivonen's sampling scheme (operator 12).

A bounded sample of the documents proposes phrases. One pass over the whole corpus then counts, exactly,
every word, every phrase whose parts the sample holds for frequent, and so the negative border too: the
phrases that are not proposed while all their parts are. Where a counted phrase turns out frequent though it
was not proposed, phrases over it were not counted yet: another pass counts those that it admits, until no
such failure is left. The sample therefore decides about the work, never about the result.

The sets of proposed phrases go to the tasks as bitmaps of a fixed size, one per length, indexed by a hash of
the phrase. A wrong bit only admits a phrase that is not needed: it is counted and dropped by its count.
Counts are grouped by the phrase's text, so that equality is exact. Tasks count blocks of a few MB before
anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved, table
from riskloom.llm.tokens import BLOCK, BYTE_BASE, Hasher, mix, utf8

MIN_COUNT, MAX_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
SAMPLE_BYTES = 16 << 20         # text that the sample holds, about
LOWER = 0.8                     # the sample's threshold, as a share of the one that its size calls for
MAP_BITS = 26                   # bitmap of 8 MB per phrase length
CHUNK = 1 << 20                 # bytes of text that are counted together in a task
SECOND_BASE = 0xD6E8FEB86659FD93
SCORE_UNIT = 1_000_000

_KIND = np.zeros(256, np.uint8)                                   # 0 word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
KEYED = "key string, f long"      # a phrase, the end of a line (no phrase holds one) and the language


class Words:
    """The words of consecutive texts: where they are in the lower-cased bytes, which piece they stand in
    and two hashes of each (one decides on bitmaps, both together on equality inside a task)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, hasher: Hasher):
        lower = data.copy()
        lower[(data >= 65) & (data <= 90)] |= 32
        kind = _KIND[lower]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = at[1:] > at[:-1]
        heads, tails = at[:-1][full], at[1:][full] - 1
        first[heads], last[tails] = word[heads], word[tails]
        self.data, self.lo, self.hi = lower, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = (np.searchsorted(at, self.lo, "right") - 1).astype(np.int32)
        ends = np.zeros(len(lower) + 1, np.int32)
        np.cumsum(kind == 2, out=ends[1:])
        broken = (ends[self.lo[1:]] > ends[self.hi[:-1]]) | (self.doc[1:] != self.doc[:-1])
        self.piece = np.concatenate([[0], np.cumsum(broken, dtype=np.int32)]).astype(np.int32) if len(self.lo) else np.zeros(0, np.int32)
        del first, last, word, kind, ends, broken
        self.one, self.two = (self._hashes(lower, base, hasher) for base in (BYTE_BASE, SECOND_BASE))

    def _hashes(self, lower: np.ndarray, base: int, hasher: Hasher) -> np.ndarray:
        found, i = np.empty(len(self.lo), np.uint64), 0
        while i < len(self.lo):                                   # some words at a time: 8 bytes for each byte of them
            j = max(i + 1, int(np.searchsorted(self.hi, self.lo[i] + BLOCK, "right")))
            a, z = self.lo[i], self.hi[j - 1]
            p, inv = hasher.table(base, z - a + 1)
            c = np.zeros(z - a + 1, np.uint64)
            np.cumsum((lower[a:z].astype(np.uint64) + np.uint64(1)) * p[:z - a], out=c[1:])
            found[i:j] = mix((c[self.hi[i:j] - a] - c[self.lo[i:j] - a]) * inv[self.lo[i:j] - a])
            i = j
        return found

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of the ``n`` words from each word on, and whether they stand in one piece."""
        size = max(0, len(self.lo) - n + 1)
        one, two = self.one[:size], self.two[:size]
        for k in range(1, n):
            one = mix(one * np.uint64(BYTE_BASE) + self.one[k:k + size])
            two = mix(two * np.uint64(SECOND_BASE) + self.two[k:k + size])
        return one, two, self.piece[:size] == self.piece[n - 1:n - 1 + size]

    def text(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words from the words ``at`` on, their words joined by one space."""
        lo, hi = (x[(at[:, None] + np.arange(n)).ravel()] for x in (self.lo, self.hi))
        size = hi - lo + 1                                        # each word and a space behind it
        end = np.cumsum(size)
        take = np.repeat(lo - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        out = self.data[np.minimum(take, len(self.data) - 1)] if len(end) else np.zeros(0, np.uint8)
        out[end - 1] = 32
        bounds = np.concatenate([[0], end[n - 1::n]])
        spaced = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out)))
        return pc.utf8_rtrim(spaced, characters=" ").cast(pa.string())


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _bits(hashes: np.ndarray, lang: str, map_bits: int) -> np.ndarray:
    return mix(hashes ^ _lang_key(lang)) >> np.uint64(64 - map_bits)


def _inside(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def _admitted(words: Words, n: int, lang: str, maps: dict[int, np.ndarray], map_bits: int) -> np.ndarray:
    """Phrases of ``n`` words whose first and last ``n - 1`` words are both in the maps."""
    ok = _inside(maps[n - 1], _bits(words.phrases(n - 1)[0], lang, map_bits))
    return ok[:-1] & ok[1:]


def _count(words: Words, lang: str, carried: int, max_words: int, maps, before, map_bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the block: words in the first pass (``before`` is None), and phrases that ``maps`` admits and
    ``before`` did not. The first ``carried`` words belong to the block before; what ends in them is counted there."""
    def rows(phrase, f):
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, pa.scalar(lang), pa.scalar("\n")), pa.array(f.astype(np.int64))], ["key", "f"])

    if before is None:
        yield rows(pa.array([""]), np.array([len(words.lo) - carried]))
    for n in range(1, max_words + 1):
        if n == 1 and before is not None or len(words.lo) < n:
            continue
        one, two, whole = words.phrases(n)
        wanted = whole
        wanted[:max(0, carried - n + 1)] = False
        if n > 1 and maps is not None:
            wanted &= _admitted(words, n, lang, maps, map_bits)
            if before is not None:
                wanted &= ~_admitted(words, n, lang, before, map_bits)
        at = np.flatnonzero(wanted)
        if not len(at):
            continue
        at = at[np.argsort(one[at], kind="stable")]
        a, b = one[at], two[at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        for k in range(0, len(new), 100_000):
            start = new[k:k + 100_000]
            stop = new[k + 1:k + 1 + 100_000]
            stop = stop if len(stop) == len(start) else np.append(stop, len(at))
            yield rows(words.text(at[start], n), stop - start)


def _cut(data: np.ndarray, limit: int, keep: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in blocks cut behind blanks or ends of pieces, each block led by the last ``keep`` words of
    the one before: (bytes, words carried). A word longer than a block makes its block longer."""
    lo = carried = 0
    while lo < len(data):
        hi = min(len(data), lo + limit)
        while hi < len(data):
            cut = np.flatnonzero(_KIND[data[lo:hi]])
            if len(cut) and cut[-1] >= limit // 2:
                hi = lo + int(cut[-1]) + 1
                break
            hi = min(len(data), hi + limit)
        yield data[lo:hi], carried
        if hi >= len(data):
            return
        kind = _KIND[data[lo:hi]] == 0
        starts = np.flatnonzero(kind & np.concatenate([[True], ~kind[:-1]]))[-keep:] if keep else np.zeros(0, int)
        carried, lo = len(starts), lo + int(starts[0]) if len(starts) else hi


def counter(max_words: int, maps=None, before=None, map_bits: int = MAP_BITS, chunk: int = CHUNK):
    """The function for ``mapInArrow`` over (lang, text); ``maps`` and ``before`` are broadcast variables or None
    (None for ``maps``: everything is admitted)."""
    def run(batches):
        hasher = Hasher()
        new, old = (x.value if x is not None else None for x in (maps, before))
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                yield from _count(Words(np.concatenate(parts), at, hasher), lang, 0, max_words, new, old, map_bits)
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, at = utf8(batch.column(1))
            for i, lang in enumerate(langs):
                text = data[at[i]:at[i + 1]]
                if len(text) > chunk:
                    for block, carried in _cut(text, chunk, max_words - 1):
                        words = Words(block, np.array([0, len(block)]), hasher)
                        yield from _count(words, lang, carried, max_words, new, old, map_bits)
                elif len(text):
                    held.setdefault(lang, []).append(text.copy())
                    size += len(text)
                    if size >= chunk:
                        yield from flush()
                        size = 0
        yield from flush()
    return run


def _missing_bits(map_bits: int, maps):
    """``mapInArrow`` over (lang, words, phrase): the bits that the maps lack, as (words, word of the map, bits)."""
    def run(batches):
        hasher = Hasher()
        have = maps.value if maps is not None else None
        for batch in batches:
            langs, sizes = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(1))
            data, at = utf8(batch.column(2))
            words = Words(data, at, hasher)
            start = np.searchsorted(words.doc, np.arange(len(sizes)))
            for n in np.unique(sizes):
                hashes = words.phrases(int(n))[0]
                for lang in set(langs[sizes == n]):
                    bits = np.unique(_bits(hashes[start[(sizes == n) & (langs == lang)]], lang, map_bits))
                    if have is not None:
                        bits = bits[~_inside(have[int(n)], bits)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), n, np.int32)), pa.array((bits >> np.uint64(6)).astype(np.int64)),
                                                      pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], ["words", "at", "bits"])
    return run


def _with_bits(frequent: DataFrame, maps: dict[int, np.ndarray] | None, shared, max_words: int, map_bits: int) -> dict[int, np.ndarray] | None:
    """The maps with the bits of the frequent phrases added, or None where none is new. At most
    2^(map_bits - 6) rows a length come to the driver, whatever the corpus."""
    parts = frequent.where(F.col("words").between(1, max_words - 1)).select("lang", "words", "phrase")
    rows = (parts.mapInArrow(_missing_bits(map_bits, shared), "words int, at long, bits long")
            .groupBy("words", "at").agg(F.bit_or("bits").alias("bits")).toArrow())
    if not rows.num_rows and maps is not None:
        return None
    size = 1 << max(0, map_bits - 6)
    out = {n: maps[n].copy() if maps else np.zeros(size, np.uint64) for n in range(1, max_words)}
    n, at, bits = (rows.column(c).to_numpy() for c in ("words", "at", "bits"))
    for k in out:
        out[k][at[n == k]] |= bits[n == k].view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_bytes: int = SAMPLE_BYTES,
                  map_bits: int = MAP_BITS, chunk: int = CHUNK, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(lang, words, phrase, f): every word and phrase of up to ``max_words`` words that occurs ``min_count`` times or more in
    its language, and one row of no words with the language's number of words. Exact for any sample."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.xxhash64(key, lang).alias("_draw") if key in docs.columns else F.xxhash64(lang, text).alias("_draw"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rate = min(1.0, sample_bytes / max(total, 1))
    sample = texts.where((F.col("_draw").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64) < F.lit(rate)) if rate < 1 else texts
    texts, sample = texts.select("lang", "text"), sample.select("lang", "text")

    def counts(rows: DataFrame, least: int, maps, before, longest: int) -> DataFrame:
        found = rows.mapInArrow(counter(longest, maps, before, map_bits, chunk), KEYED).groupBy("key").agg(F.sum("f").alias("f"))
        phrase = F.substring_index("key", "\n", 1)
        spaces = F.length(phrase) - F.length(F.replace(phrase, F.lit(" ")))
        return (found.where((F.col("f") >= least) | F.startswith("key", F.lit("\n")))
                .select(F.expr("substring(key, locate('\\n', key) + 1)").alias("lang"), F.when(phrase == "", 0).otherwise(spaces + 1).alias("words"), phrase.alias("phrase"), "f"))

    least = max(min(2, min_count), math.ceil(LOWER * rate * min_count))
    proposed = saved(counts(sample, least, None, None, max(1, max_words - 1)), "phrases-proposed")
    maps = _with_bits(proposed, None, None, max_words, map_bits)
    shared, before, passes = spark.sparkContext.broadcast(maps), None, []
    while maps is not None:
        passes.append(saved(counts(texts, min_count, shared, before, max_words), f"phrases-pass{len(passes) + 1}"))
        maps = _with_bits(passes[-1], maps, shared, max_words, map_bits)
        before, shared = shared, spark.sparkContext.broadcast(maps) if maps is not None else None
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP,
                 inside_percent: int = INSIDE_PERCENT, text: str = "text", lang: str = "lang", key: str = "doc_id", **limits) -> DataFrame:
    """The collocations of each language: (lang, rank, phrase, a, l, r, n, score), best first.

    A phrase of 2 to ``max_words`` words that occurs ``a >= min_count`` times is a candidate. Its cut after ``k`` words
    scores floor(10^6 a^2 / (l r)) with the counts of both parts; the lowest cut counts, ties go to the smallest k.
    Candidates inside a longer candidate with ``inside_percent`` or more of their count are dropped, also where that
    one is dropped itself (one word longer suffices: a still longer one contains one in between that is as frequent).

    Null texts count as empty, a null language as ``und``. Texts without words, empty tables: no rows. Repeated rows count
    each time. Columns other than ``text``, ``lang`` and ``key`` are not read, whatever their names; ``key`` only spreads
    the sample and may be missing. Very long texts are counted in blocks. Equal scores and counts: by the phrase's bytes."""
    found = phrase_counts(docs, min_count, max_words, text=text, lang=lang, key=key, **limits)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = found.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    phrases = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    tokens = F.split("phrase", " ", -1)
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(tokens, F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice(tokens, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    heads = parts.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l"))
    tails = parts.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r"))
    wide = "decimal(38,0)"
    scored = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
              .withColumn("score", F.expr(f"CAST((CAST({SCORE_UNIT} * CAST(a AS decimal(16,0)) AS {wide}) * CAST(a AS decimal(16,0))) div "
                                          f"(CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS long)")))
    best = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    words = F.split("phrase", " ", -1)
    inner = phrases.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside_percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")).withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM lists
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists WHERE len(w) > 2),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 10),
cuts AS (SELECT lang, words, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
    UNION ALL SELECT lang, words, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE words = 3),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
    FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""


@query("op12_collocations", ORACLE)
def q_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
