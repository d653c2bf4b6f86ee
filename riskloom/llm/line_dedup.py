"""Operator 2: removal of lines that an earlier line repeats up to one edit of a word.

Lines are compared as sequences of words; an edit inserts, deletes or replaces one word, and the bound
is one edit. Every line's deletion neighbourhood (the line without its i-th word, for each i) and the
line itself become hashed keys, and equal keys are joined: two lines without their i-th words are equal
when they differ in that word only, and a line equals another without one word when that word was
inserted. Joined pairs are verified by their edit distance. Equal lines meet in their own hash first,
so each different line enters the neighbourhood once, whatever its copies.

Lines within one edit share their first or their last half, so only lines with a half in common with
another line emit variants; that sieve loses no pair.

A line is removed when the same or a near line begins earlier (by identifier, then line number),
whether or not that one stays itself. Near lines have ``MIN_WORDS`` words or more; equal lines are found
from ``exact_words`` words on, in the queries from one (lines without words stay).

Defined results: null text stays null and has no lines; rows that share an identifier share places, so
repeated rows keep equal lines; rows without an identifier come last; an empty table gives no rows; a
document whose lines all go keeps its row with empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.llm.registry import query, saved, table
from riskloom.llm.tokens import WORD_BASE, Hasher, blocks, mix
from riskloom.session import checkpoint_dir

MIN_WORDS, EXACT_WORDS = 5, 1
HALF_FIRST, HALF_LAST = 0x5851F42D4C957F2D, 0x14057B7EF767814F


class Lines:
    """The lines of a block of texts: their words' prefix sums, so any run of words can be hashed."""

    def __init__(self, hasher: Hasher, data: np.ndarray, at: np.ndarray):
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate([at[:-1], breaks[breaks < len(data)]])) if len(data) else np.zeros(0, np.int64)
        self.at = np.append(starts, len(data))
        self.doc = np.searchsorted(at, starts, "right") - 1
        self.number = np.arange(len(starts)) - np.searchsorted(starts, at[self.doc])
        words, offsets = hasher.words(data, self.at)
        p, self.inv = hasher.table(WORD_BASE, len(words) + 2)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * p[:len(words)], out=self.sums[1:])
        self.lo, self.hi = offsets[:-1], offsets[1:]
        self.size = self.hi - self.lo

    def raw(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.inv[lo]

    def hashes(self) -> np.ndarray:
        return mix(self.raw(self.lo, self.hi) ^ mix(self.size.astype(np.uint64)))

    def halves(self) -> np.ndarray:
        """Four keys per line: first and last half, as the shorter and as the longer of two lines."""
        out = []
        for h in (self.size // 2, np.maximum(self.size - 1, 0) // 2):
            n = mix(h.astype(np.uint64))
            out += [mix(self.raw(self.lo, self.lo + h) ^ n ^ np.uint64(HALF_FIRST)), mix(self.raw(self.hi - h, self.hi) ^ n ^ np.uint64(HALF_LAST))]
        return np.stack(out, 1)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, position, key) of every line without its i-th word, and of the line itself (-1)."""
        line = np.repeat(np.arange(len(self.lo)), self.size)
        word = np.arange(len(line)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at = self.lo[line] + word
        tail = (self.sums[self.hi[line]] - self.sums[at + 1]) * self.inv[self.lo[line] + 1]
        less = self.raw(self.lo[line], at) + tail
        key = mix(less ^ mix((self.size[line] - 1).astype(np.uint64)))
        return (np.append(line, np.arange(len(self.lo))), np.append(word, np.full(len(self.lo), -1)), np.append(key, self.hashes()))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Word edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def _hashed(batches: Iterator[pa.RecordBatch], least: int, near: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Lines of at least ``least`` words: hash, place, and the text or the row's key and half keys (none
    below ``near`` words)."""
    hasher = Hasher()
    for b in batches:
        for first, _, data, at in blocks(b.column(1)):
            lines = Lines(hasher, data, at)
            keep = np.flatnonzero(lines.size >= least)
            out = [pa.array(lines.hashes()[keep].view(np.int64)), b.column(0).take(pa.array(first + lines.doc[keep])),
                   pa.array(lines.number[keep].astype(np.int32))]
            if with_text:
                out.append(pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(lines.at[keep], lines.at[keep + 1])], pa.string()))
            else:
                full = lines.size[keep] >= near
                keys = lines.halves()[keep[full]].view(np.int64)
                out.append(b.column(2).take(pa.array(first + lines.doc[keep])))
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * 4)).astype(np.int32)), pa.array(keys.ravel())))
            yield pa.RecordBatch.from_arrays(out, ["line", "doc_id", "no", *(["text"] if with_text else ["row", "halves"])])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        for first, _, data, at in blocks(b.column("text")):
            lines = Lines(hasher, np.where(data == 10, 32, data).astype(np.uint8), at)
            line, position, key = lines.variants()
            row = pa.array(first + lines.doc[line])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(position.astype(np.int32)),
                                              *(b.column(c).take(row) for c in ("line", "doc_id", "no"))], ["key", "position", "line", "doc_id", "no"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one_edit(x.as_py().split(), y.as_py().split()) for x, y in zip(b.column("text"), b.column("near_text"))]
        yield b.filter(pa.array(ok, pa.bool_()))


def _few(keys: DataFrame, bound: int) -> DataFrame:
    """A broadcast while it is counted to be small, else a shuffled join."""
    return F.broadcast(keys) if keys.count() <= bound else keys


def _place():
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "no")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_rows: int = 500_000, exact_words: int = MIN_WORDS) -> DataFrame:
    """``row, doc_id, no, line, first`` of the lines of ``docs`` (``doc_id, text, row``) that go: the
    key of their row, their number, their hash and the place of the earliest line like them."""
    lines = saved(docs.mapInArrow(lambda it: _hashed(it, min(exact_words, min_words), min_words, False), "line long, doc_id long, no int, row long, halves array<long>"), "lines")
    firsts = saved(lines.groupBy("line").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")), "lines-first")

    # the sieve: lines that share a half with another line
    halves = lines.select("line", F.explode(F.array_distinct("halves")).alias("half"))
    shared = saved(halves.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("half"), "lines-halves")
    near = saved(halves.join(_few(shared, broadcast_rows), "half", "left_semi").select("line").distinct()
                 .join(firsts, "line").select("line", "first.doc_id", "first.no"), "lines-near")
    texts = docs.mapInArrow(lambda it: _hashed(it, min_words, min_words, True), "line long, doc_id long, no int, text string")
    same = near.select(F.col("line"), F.col("doc_id").alias("d"), F.col("no").alias("k"))
    texts = saved(texts.join(_few(same, broadcast_rows), "line").where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("no") == F.col("k")))
                  .select("line", "doc_id", "no", "text").dropDuplicates(["line"]), "lines-text")

    # equal variants
    emitted = texts.mapInArrow(_variants, "key long, position int, line long, doc_id long, no int")
    several = saved(emitted.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("key"), "lines-keys")
    variants = saved(emitted.join(_few(several, broadcast_rows), "key", "left_semi").withColumn("place", _place()).drop("doc_id", "no"), "lines-variants")
    replaced = saved(variants.where("position >= 0").groupBy("key", "position")
                     .agg(F.min(F.struct("place", "line")).alias("near")), "lines-replaced")
    inserted = saved(variants.groupBy("key").agg(F.min(F.when(F.col("position") >= 0, F.struct("place", "line"))).alias("longer"),
                                                 F.min(F.when(F.col("position") < 0, F.struct("place", "line"))).alias("whole"))
                     .where("longer IS NOT NULL AND whole IS NOT NULL"), "lines-inserted")
    pairs = (variants.join(replaced, ["key", "position"]).select("line", "place", "near")
             .unionByName(variants.join(inserted, "key").select("line", "place", F.when(F.col("position") < 0, F.col("longer")).otherwise(F.col("whole")).alias("near")))
             .where(F.col("near.place") < F.col("place")).select("line", "near.line", "near.place").toDF("line", "near_line", "place").distinct())
    pairs = (pairs.join(texts.select("line", "text"), "line")
             .join(texts.select(F.col("line").alias("near_line"), F.col("text").alias("near_text")), "near_line"))
    checked = pairs.select("line", "place", "text", "near_text")
    found = saved(checked.mapInArrow(_verified, checked.schema).groupBy("line").agg(F.min("place").alias("near")), "lines-found")

    # least() takes no structs: the earlier of the line's own first place and that of a near line
    first = F.when(F.col("near").isNotNull() & (F.col("near") < F.col("first")), F.col("near")).otherwise(F.col("first"))
    earliest = saved(firsts.join(found, "line", "left").where("n > 1 OR near IS NOT NULL").select("line", first.alias("first")), "lines-earliest")
    return lines.drop("halves").join(earliest, "line").where(F.col("first") < _place()).select("row", "doc_id", "no", "line", "first")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
               broadcast_rows: int = 500_000, removed: str = "lines_removed", exact_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without its repeated lines, and with their number (a column of that name is replaced).
    Lines of ``min_words`` words or more are compared up to one edit, shorter ones down to ``exact_words``
    words for equality."""
    checkpoint_dir(docs.sparkSession)
    docs = docs.drop(removed)
    # a row is known by the hash of its identifier and text: rows equal in both lose the same lines
    row = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row.alias("row"))
    gone = (repeated_lines(narrow, min_words, broadcast_rows, exact_words).select(F.col("row").alias("_row"), "no").distinct()
            .groupBy("_row").agg(F.collect_list("no").alias("_gone")))
    joined = docs.withColumn("_row", row).join(saved(gone, "lines-gone"), "_row", "left").drop("_row")
    position = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(removed, LongType())])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n = [], []
            for t, numbers in zip(b.column(position), b.column(len(names) - 1)):
                t, numbers = t.as_py(), set(numbers.as_py() or ())
                if t is not None and numbers:
                    parts = t.split("\n")
                    stay = [p for i, p in enumerate(parts) if i not in numbers]
                    n.append(len(parts) - len(stay))
                    t = "\n".join(stay)
                else:
                    n.append(0)
                kept.append(t)
            columns = list(b.columns[:-1])
            columns[position] = pa.array(kept, columns[position].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=names)

    return joined.mapInArrow(cut, schema)


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, exact_words=EXACT_WORDS).select("doc_id", "lines_removed", F.octet_length(F.coalesce("text", F.lit(""))).alias("kept_bytes"),
                                   F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
