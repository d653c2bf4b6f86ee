"""Alignment of two tokenizers over the same texts (operator 11).

Each task encodes its documents with both tokenizers, batch by batch. ``pandas.merge_asof``, keyed by document, finds
for the start of each token the token of the other side that covers it; the union of both directions is the overlaps.
Byte offsets at which tokens of both sides end cut a text into groups.

How often two identifiers are linked is counted over the corpus. Tasks number the distinct pairs of a chunk of
bounded size, send only those with their counts, and store the links as places in that list. The totals come back
to the chunk as one list, with which its links are looked up. Nothing is encoded twice but texts over a
segment's size: they are cut where neither tokenizer can join, and first checked as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.registry import query, saved, table

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH = 1 << 18                 # characters that are encoded together
SEGMENT = 1 << 20               # characters from which a text is cut
LINKS = 1 << 18                 # links from which a chunk is closed
SPACE = "▁"                # the piece tokenizer's space (fixed value)
# How a byte-level vocabulary file describes itself, and the pattern that it splits texts by.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """The bytes of each identifier of a vocabulary, and its number as text behind each separator."""

    def __init__(self, entries: dict[int, bytes], separators: tuple[str, str]):
        n = max(entries, default=-1) + 1
        self.size = np.array([len(entries.get(i, b"")) for i in range(n)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(entries.get(i, b"") for i in range(n)), np.uint8)
        self.first, self.next = (np.array([f"{s}{i}" for i in range(n)], object) for s in separators)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class Pair:
    """Both tokenizers, from the content of their files; built once in each worker.

    The byte-level one is run by merge ranks, which are the identifiers. That gives the file's own merges: once all merges of
    lower rank are done, the bytes of an entry hold the same two tokens as they do alone, the pair that makes the entry."""

    def __init__(self, a_json: str, b_model: bytes):
        self.files, self.ready = (a_json, b_model), False

    def load(self) -> Pair:
        if not self.ready:
            from sentencepiece import SentencePieceProcessor
            from tiktoken import Encoding
            described = json.loads(self.files[0])
            if described["normalizer"] is not None or described["pre_tokenizer"] != BYTE_LEVEL:
                raise ValueError("the first tokenizer must be a byte-level one without normalizer")
            alphabet = byte_alphabet()
            entries = {i: bytes(alphabet[c] for c in entry) for entry, i in described["model"]["vocab"].items()}
            self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks={entry: i for i, entry in entries.items()}, special_tokens={})
            self.b = SentencePieceProcessor(model_proto=self.files[1])
            self.side_a = Side(entries, (";", ","))
            pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
            self.side_b = Side({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}, ("|", ","))
            self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
            self.ready = True
        return self

    def encode(self, texts: list[str]) -> tuple[list, list]:
        return [self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1)

    def segments(self, text: str, size: int) -> Iterator[str]:
        """A long text cut at single spaces between word characters: the byte-level tokenizer splits in front of them, and
        no piece of the other holds a space behind another character. The space goes to the segment behind it."""
        lo = 0
        while self.cuttable and len(text) - lo > size:
            cut = _BETWEEN_WORDS.search(text, lo + size)
            if cut is None:
                break
            yield text[lo:cut.start()]
            lo = cut.end()
        yield text[lo:]


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in ids] or [np.zeros(0, np.int64)]), n


def _covering(starts: np.ndarray, docs: np.ndarray, others: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each start the place of the other side's token that covers it."""
    left = pd.DataFrame({"start": starts, "doc": docs})
    right = pd.DataFrame({"start": others, "doc": other_docs, "place": np.arange(len(others))})
    return pd.merge_asof(left, right, on="start", by="doc")["place"].to_numpy().astype(np.int64)


class Aligned:
    """The alignment of a batch of texts: per text the numbers of tokens, groups and links and the groups as text
    (None where the texts have no tokens), and the links' identifier pairs, text by text."""

    def __init__(self, pair: Pair, texts: list[str]):
        a_side, b_side = pair.side_a, pair.side_b
        (a, n_a), (b, n_b) = (_flat(x) for x in pair.encode(texts))
        wanted = [b" " + t.encode() if t else None for t in texts]
        ok = np.array([w is not None for w in wanted])
        for side, ids, n in ((a_side, a, n_a), (b_side, b, n_b)):
            data, at = side.joined(ids), np.concatenate([[0], np.cumsum(side.size[ids])])
            at = at[np.concatenate([[0], np.cumsum(n)])]
            ok &= np.array([w is not None and data[at[i]:at[i + 1]].tobytes() == w for i, w in enumerate(wanted)], bool)
        self.ok = ok
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        self.n_a, self.n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        self.n_groups = self.n_links = np.zeros(len(texts), np.int64)
        self.groups, self.pairs = [None] * len(texts), np.zeros(0, np.int64)
        if not len(a):
            return
        doc_a, doc_b = np.repeat(np.arange(len(texts)), self.n_a), np.repeat(np.arange(len(texts)), self.n_b)
        end_a, end_b = np.cumsum(a_side.size[a]), np.cumsum(b_side.size[b])
        start_a, start_b = end_a - a_side.size[a], end_b - b_side.size[b]
        b_of_a = _covering(start_a, doc_a, start_b, doc_b)
        a_of_b = _covering(start_b, doc_b, start_a, doc_a)
        inner = np.flatnonzero(start_a[a_of_b] != start_b)        # equal starts are found from both sides
        at = np.concatenate([np.arange(len(a)), a_of_b[inner]])
        to = np.concatenate([b_of_a, inner])
        order = np.argsort(doc_a[at], kind="stable")
        at, to = at[order], to[order]
        self.pairs = (a[at] << 32) | b[to]
        self.n_links = np.bincount(doc_a[at], minlength=len(texts))
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        last = np.flatnonzero(np.isin(end_a, ends, assume_unique=True))
        self.n_groups = np.bincount(doc_a[last], minlength=len(texts))
        # the groups as text: a group's tokens of A, then those of B, each behind its separator
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        head_a, head_b = (np.concatenate([[True], g[1:] != g[:-1]]) for g in (group_a, group_b))
        words = np.empty(len(a) + len(b), object)
        words[place_a] = np.where(head_a, a_side.first[a], a_side.next[a])
        words[place_b] = np.where(head_b, b_side.first[b], b_side.next[b])
        words, at = words.tolist(), np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        self.groups = ["".join(words[at[i]:at[i + 1]])[1:] if ok[i] else None for i in range(len(texts))]


_DOC = [("key", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_DOC_SQL = "key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _packed(places: np.ndarray, among: int) -> bytes:
    """Places among so many pairs as compressed bytes, behind the number of bytes of each."""
    kind = np.dtype("<u2" if among <= 1 << 16 else "<u4")
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(places.astype(kind).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _chunks(shared, id_type: pa.DataType, batch_chars: int, segment: int, links: int):
    """``mapInArrow`` over (id, text): one row per chunk, with its documents, its distinct pairs with their counts,
    and its links as places among those. A text may go on in the next chunk under the same key."""
    schema = pa.schema([("chunk", pa.string()), ("docs", pa.list_(pa.struct([("id", id_type), *_DOC]))), ("pairs", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("links", pa.binary())])

    def run(batches):
        pair = shared.value.load()
        part = TaskContext.get().partitionId()
        docs, keys, held, number, chunk = [], [], 0, 0, 0

        def add(identifier, key, aligned, i, sha):
            docs.append({"id": identifier, "key": key, "n_a": int(aligned.n_a[i]), "n_b": int(aligned.n_b[i]), "n_groups": int(aligned.n_groups[i]),
                         "n_links": int(aligned.n_links[i]), "groups_sha256": sha})

        def closed():
            nonlocal docs, keys, held, chunk
            found, at, n = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            row = {"chunk": f"{part}-{chunk}", "docs": docs, "pairs": found, "counts": n, "links": _packed(at, len(found))}
            docs, keys, held, chunk = [], [], 0, chunk + 1
            return pa.RecordBatch.from_pylist([row], schema)

        def some(ids, texts):
            nonlocal held, number
            aligned = Aligned(pair, texts)
            for i, identifier in enumerate(ids):
                sha = hashlib.sha256(aligned.groups[i].encode()).hexdigest() if aligned.ok[i] else ""
                add(identifier, f"{part}-{number}", aligned, i, sha)
                number += 1
            keys.append(aligned.pairs)
            held += len(aligned.pairs)

        for batch in batches:
            ids, texts, chars = [], [], 0
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if len(text) <= segment:
                    ids.append(identifier)
                    texts.append(text)
                    chars += len(text)
                    if chars >= batch_chars:
                        some(ids, texts)
                        ids, texts, chars = [], [], 0
                elif all(Aligned(pair, [s]).ok[0] for s in pair.segments(text, segment)):
                    key, sha = f"{part}-{number}", hashlib.sha256()
                    number += 1
                    for k, piece in enumerate(pair.segments(text, segment)):
                        aligned = Aligned(pair, [piece])
                        sha.update((";" * (k > 0) + aligned.groups[0]).encode())
                        add(identifier, key, aligned, 0, None)
                        keys.append(aligned.pairs)
                        held += len(aligned.pairs)
                        if held >= links:
                            yield closed()
                    docs.append({"id": identifier, "key": key, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": sha.hexdigest()})
                else:
                    some([identifier], [""])
                if held >= links:
                    yield closed()
            if ids:
                some(ids, texts)
            if held >= links:
                yield closed()
        if docs:
            yield closed()
    return run


def _looked_up(id_type: pa.DataType):
    """``mapInArrow`` over (docs, links, totals): per document of a chunk the sums over its links."""
    schema = pa.schema([("id", id_type), *_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches):
        for batch in batches:
            for docs, links, totals in zip(batch.column("docs"), batch.column("links"), batch.column("totals")):
                at = _unpacked(links.as_py())
                total, best = np.zeros(at.max(initial=-1) + 1, np.int64), np.zeros(at.max(initial=-1) + 1, np.int64)
                if totals.is_valid:
                    place = totals.values.field("place").to_numpy()
                    total[place], best[place] = totals.values.field("total").to_numpy(), totals.values.field("best").to_numpy()
                sums, bests = (np.concatenate([[0], np.cumsum(v[at])]) for v in (total, best))
                rows = docs.as_py()
                end = np.cumsum([0] + [r["n_links"] for r in rows])
                yield pa.RecordBatch.from_pylist([r | {"n_best": int(bests[hi] - bests[lo]), "count_sum": int(sums[hi] - sums[lo])}
                                                  for r, lo, hi in zip(rows, end[:-1], end[1:])], schema)
    return run


def token_alignment(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", doc_id: str = "doc_id", text: str = "text",
                    batch_chars: int = BATCH, segment: int = SEGMENT, links: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """The alignment of a byte-level vocabulary (``a_path``; it reads a space and the text) with a piece model (``b_path``, which
    adds that space itself). The files are read where the driver runs; 2 MB go to the tasks. Two frames:

    * per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    * the corpus' pair counts: ``a_id, b_id, n, best`` (whether no other A identifier is linked with the B identifier more often)

    Null and empty texts, and those whose tokens of either side don't give back a space and the text, have no tokens: zeros and
    an empty digest. Rows that repeat, share an identifier or have none stay rows of their own; their links count each time.
    Ties: every pair with the highest count is best. An empty table gives empty frames. Other columns are not read, whatever their
    names. Texts above ``segment`` characters are cut between words, without effect on the result; those without such a place,
    and texts below, are encoded whole."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = spark.sparkContext.broadcast(Pair(f.read(), g.read()))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    chunks = saved(rows.mapInArrow(_chunks(shared, id_type, batch_chars, segment, links),
                                   f"chunk string, docs array<struct<id: {kind}, key: string, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, "
                                   "groups_sha256: string>>, pairs array<bigint>, counts array<bigint>, links binary"), "aligned-chunks")
    sent = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("chunk", "place", "p.pairs", "p.counts")
    totals = sent.groupBy("pairs").agg(F.sum("counts").alias("total")).withColumn("b_id", F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)))
    totals = saved(totals, "pair-totals")
    most = totals.groupBy("b_id").agg(F.max("total").alias("most"))                    # at most as many rows as B has identifiers
    totals = totals.join(F.broadcast(most), "b_id").select("pairs", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    back = (sent.select("chunk", "place", "pairs").join(totals, "pairs")
            .groupBy("chunk").agg(F.collect_list(F.struct("place", "total", "best")).alias("totals")))
    parts = (chunks.select("chunk", "docs", "links").join(back, "chunk", "left").select("docs", "links", "totals")
             .mapInArrow(_looked_up(id_type), f"id {kind}, {_DOC_SQL}, n_best long, count_sum long"))
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    found = parts.groupBy("key").agg(F.min("id").alias("doc_id"), *(F.sum(c).cast("long").alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256"))
    counts = totals.select(F.shiftright("pairs", 32).alias("a_id"), F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("total").alias("n"), (F.col("best") == 1).alias("best"))
    return found.drop("key"), counts


@query("op11_token_alignment")
def q_token_alignment(spark, sf_dir):
    return token_alignment(table(spark, sf_dir, "documents"))[0]
