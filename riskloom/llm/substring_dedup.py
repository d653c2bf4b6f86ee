"""Operator 1: removal of long word sequences that an earlier document already has.

Every window of 50 consecutive words gets a Karp-Rabin hash. Documents are dealt into chunks of
neighbouring identifiers; a chunk sends each of its distinct window hashes once, as sorted blocks per
bucket of the hash range, so a passage that a third of all documents share costs one entry a chunk.
Each bucket finds the earliest chunk of every hash and answers every later chunk with one bit per
entry. Chunks lie in identifier order, so an earlier chunk means a smaller identifier; inside a chunk
the identifiers decide. The answer is laid over the chunk's texts again, where repeated windows merge
into maximal intervals. The texts are shuffled once (both uses share the exchange); a window costs
about six shuffled bytes and returns as a bit.

Hashes have 64 bits; two different windows are taken for equal with probability n^2 / 2^65 for n
windows in all (about one chance in a thousand for 10^8).

Defined results: null text has no words; texts shorter than a window lose nothing; rows of equal
identifier don't remove from one another, so of repeated rows all keep their words; rows without an
identifier come after all others and don't remove from one another; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, table
from riskloom.llm.tokens import Hasher, bucket_cuts, deltas, from_deltas, starts_inside, utf8

WINDOW = 50
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
NO_ID = 1 << 62


class Chunk:
    """The windows of one chunk of documents, sorted by hash."""

    def __init__(self, rows: pa.Table, window: int, buckets: int):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = rows["doc_id"].to_pylist()
        data, at = utf8(rows["text"])
        self.texts = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        hasher = Hasher()
        words, self.offsets = hasher.words(data, at)
        inside = np.flatnonzero(starts_inside(self.offsets, window))
        hashes = hasher.windows(words, window)[inside]
        order = np.argsort(hashes, kind="stable")
        self.starts, hashes = inside[order], hashes[order]
        self.new = np.ones(len(hashes), bool)
        self.new[1:] = hashes[1:] != hashes[:-1]
        self.distinct = hashes[self.new]
        self.cuts = bucket_cuts(self.distinct, buckets)

    def filled(self):
        return np.flatnonzero(self.cuts[1:] > self.cuts[:-1])

    def removed(self, seen: np.ndarray) -> np.ndarray:
        """Words covered by a window seen in an earlier chunk or under a smaller identifier here."""
        run = np.cumsum(self.new) - 1
        gone = seen[run]
        if self.ids and self.ids[0] is not None and len(run):
            ids = np.repeat(np.array(self.ids, np.int64), np.diff(self.offsets))[self.starts]
            gone = gone | (ids > ids[np.flatnonzero(self.new)][run])
        return self.starts[gone]


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                    with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, intervals`` (removed
    word ranges, end exclusive) and, if asked for, ``kept_text``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total, mean = rows.agg(F.sum(F.octet_length("text")), F.avg(F.octet_length("text"))).first()
    width = max(1, int(chunk_bytes / max(mean or 1, 1)))
    buckets = max(8, -(-int(total or 0) // bucket_bytes))
    chunks = max(1, -(-int(total or 0) // chunk_bytes))
    rows = rows.select(F.coalesce(F.expr(f"doc_id div {width}"),
                                  F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(chunks))).alias("chunk"),
                       "doc_id", "text")

    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = Chunk(rows, window, buckets)
        filled = c.filled()
        return pa.table({"bucket": pa.array(filled, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(filled), pa.int64()),
                         "hashes": pa.array([deltas(c.distinct[c.cuts[b]:c.cuts[b + 1]]) for b in filled], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        chunk = rows["chunk"].to_numpy()
        parts = [from_deltas(x.as_buffer()) for x in rows["hashes"]]
        sizes = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = chunk[owner[np.flatnonzero(new)]][np.cumsum(new) - 1]
        seen = np.empty(len(hashes), bool)
        seen[order] = (chunk[owner] > first) & (first < NO_ID)
        bits = np.split(seen, np.cumsum(sizes)[:-1])
        hit = [i for i, b in enumerate(bits) if b.any()]
        return pa.table({"chunk": pa.array(chunk[hit], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()),
                         "bits": pa.array([np.packbits(bits[i]).tobytes() for i in hit], pa.binary())})

    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows, window, buckets)
        seen = np.zeros(len(c.distinct), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"]):
            lo, hi = c.cuts[b], c.cuts[b + 1]
            seen[lo:hi] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo).astype(bool)
        edge = np.zeros(int(c.offsets[-1]) + 1, np.int64)
        gone = c.removed(seen)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "intervals": [], "kept_text": []}
        for words, lo, hi in zip(c.texts, c.offsets[:-1], c.offsets[1:]):
            words, kept = words.split(), keep[lo:hi]
            flips = np.flatnonzero(np.diff(kept.astype(np.int8), prepend=1, append=1))
            joined = b" ".join(words if not len(flips) else compress(words, kept))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(hi - lo - kept.sum()))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["intervals"].append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
            out["kept_text"].append(joined.decode() if with_text else None)
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                         "intervals": pa.array(out["intervals"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept_text": pa.array(out["kept_text"], pa.string())})

    sent = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, bits binary")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, "
             "intervals array<struct<start: long, end: long>>, kept_text string")
    return out if with_text else out.drop("kept_text")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("intervals")
