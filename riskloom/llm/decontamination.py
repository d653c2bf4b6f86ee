"""Operator 5: benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a run of ``MIN_MATCH`` words (Karp-Rabin hashes of
lower-cased words). For pairs whose shared runs could cover enough of the item, the longest common run
of unmarked words is marked again and again until none of ``MIN_MATCH`` words is left; the item is
found in the document when the marked share of its words reaches the threshold, in whatever order its
parts stand there.

The benchmark is the query set: it goes out in blocks of bounded size, and every block is held
against all whole texts where they lie, without a shuffle.

Defined results: items of fewer than ``MIN_MATCH`` words can't be tested and match nothing; null texts
have no words; repeated rows (of either table) each get their matches; empty tables give no matches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, table
from riskloom.llm.tokens import Hasher, blocks, starts_inside, utf8

MIN_MATCH, COVERAGE = 5, 0.6
BLOCK_BYTES = 8 << 20


def tiles(seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from all places (i in the text, j in the item) where ``k`` words agree: marked
    ``(i, j, length)``, longest first, then by i and j."""
    runs, seeds = [], sorted(seeds, key=lambda s: (s[0] - s[1], s[0]))
    for i, j in seeds:
        if runs and runs[-1][0] - runs[-1][1] == i - j and runs[-1][0] + runs[-1][2] - k + 1 == i:
            runs[-1][2] += 1
        else:
            runs.append([i, j, k])
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    text, item, out = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [d for d in range(-n) if i + d not in text and j + d not in item]
        if len(free) == -n:
            text.update(range(i, i - n))
            item.update(range(j, j - n))
            out.append((i, j, -n))
            continue
        start = 0
        for x in range(1, len(free) + 1):           # what is left of it, as runs of free words
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, i + free[start], j + free[start]))
                start = x
    return out


class Items:
    """A block of benchmark items: sorted seeds with the places where they stand."""

    def __init__(self, rows: list[tuple], k: int, coverage: float):
        self.k, self.coverage, self.ids = k, coverage, [r[0] for r in rows]
        hasher = Hasher()
        data, at = utf8(pa.array([r[1] or "" for r in rows], pa.string()))
        words, offsets = hasher.words(data, at, lower=True)
        self.sizes = np.diff(offsets)
        inside = np.flatnonzero(starts_inside(offsets, k))
        seeds = hasher.windows(words, k)[inside] if len(inside) else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.item = np.searchsorted(offsets, inside, "right")[order] - 1
        self.place = inside[order] - offsets[self.item]

    def matches(self, texts: pa.Array) -> Iterator[list[tuple[int, int, list]]]:
        """For each text: (item number, marked words, tiles) of the items found in it."""
        hasher = Hasher()
        for first, end, data, at in blocks(texts):
            words, offsets = hasher.words(data, at, lower=True)
            found: dict[int, dict[int, list]] = {}
            valid = starts_inside(offsets, self.k)
            if len(valid) and len(self.seeds):
                grams = hasher.windows(words, self.k)
                lo = np.searchsorted(self.seeds, grams)
                hits = np.flatnonzero(valid & (self.seeds[np.minimum(lo, len(self.seeds) - 1)] == grams))
                hi = np.searchsorted(self.seeds, grams[hits], "right")
                owner = np.searchsorted(offsets, hits, "right") - 1
                for h, a, b, d in zip(hits.tolist(), lo[hits].tolist(), hi.tolist(), owner.tolist()):
                    for s in range(a, b):
                        found.setdefault(d, {}).setdefault(int(self.item[s]), []).append((h - int(offsets[d]), int(self.place[s])))
            for d in range(end - first):
                out = []
                for item, seeds in sorted(found.get(d, {}).items()):
                    need = self.coverage * self.sizes[item]
                    if len({p + x for _, p in seeds for x in range(self.k)}) >= need:
                        marked = tiles(seeds, self.k)
                        if sum(n for *_, n in marked) >= need:
                            out.append((item, sum(n for *_, n in marked), sorted(marked)))
                yield out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, k: int, coverage: float, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Items(sorted(map(tuple, part.collect()), key=str), k, coverage)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` and item found in it: ``doc_id, item_id, marked_words, item_words,
    coverage, tiles`` (text word, item word, length)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = ("doc_id long, item_id long, marked_words long, item_words long, coverage double, "
              "tiles array<struct<text: long, item: long, length: long>>")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_id, item_text, min_match, coverage, block_bytes):
        def match(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, items.ids[i], n, int(items.sizes[i]), n / int(items.sizes[i]), [{"text": x, "item": y, "length": z} for x, y, z in t])
                         for d, row in zip(b.column(0).to_pylist(), items.matches(b.column(1))) for i, n, t in row]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
                         pa.list_(pa.struct([("text", pa.int64()), ("item", pa.int64()), ("length", pa.int64())]))))],
                        ["doc_id", "item_id", "marked_words", "item_words", "coverage", "tiles"])

        out = out.unionByName(rows.mapInArrow(match, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    position = docs.columns.index(text)
    for items in item_blocks(benchmark, item_id, item_text, min_match, coverage, block_bytes):
        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not found for found in items.matches(b.column(position))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")
