"""Operator 9: toxicity from compression lengths.

Two zstandard dictionaries are trained: one on ordinary text, and one on toxic text that follows the
same ordinary content, so a window of words compresses to the same length under both unless the toxic
part explains it. Training text is purified by cross-fitting: the windows of one half of the toxic
sample are kept if the other half's toxic dictionary shortens them more than it shortens all but one
in a thousand ordinary windows; ordinary windows that it shortens as much join the ordinary content.
A text's gains (bytes saved per window: largest, means of the largest, mean, shares) are calibrated
to a probability by a logistic fit on labelled texts of which no dictionary has seen a window.

Fit on a bounded sample: per class at most ``SAMPLE_DOCS`` labelled rows in the order of a hash of
the identifier and at most ``SAMPLE_BYTES`` of whole texts; rows held out never enter. Scoring reads
every window of every text; labels, language, source and identifier are not inputs of a score.

Defined results: null and empty texts have one empty window and get its score; without labelled rows
of both classes every score is the share of label 1 (0 without any); rows without an identifier are
scored and count as not held out, but are never learnt from; repeated rows get equal scores; an empty
table gives no rows.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskloom.llm.registry import query, table
from riskloom.llm.tokens import Hasher, blocks

SAMPLE_DOCS, SAMPLE_BYTES = 3000, 10 << 20
WORDS = 2
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 64 << 10, 64 << 10, 8 << 10
ROUNDS, RARE = 6, 0.999
FALSE_SHARE = 0.03              # of ordinary calibration texts that a model's threshold lets be rejected
#: Opens every window and closes every dictionary, so that short windows are compressed at all.
MARK = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11"


def windows(text: str | None, words: int = WORDS) -> list[bytes]:
    """Whole text as windows of a few words, lower-cased."""
    w = (text or "").lower().encode("utf-8", "replace").split()
    return [MARK + b" " + b" ".join(w[i:i + words]) + b" " for i in range(0, max(len(w), 1), words)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(
        3, dict_size=len(content), strategy=zstandard.STRATEGY_DFAST, min_match=4, target_length=64, search_log=5,
        window_log=20, hash_log=17, chain_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(c: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    pack = c.compress
    return np.array([len(pack(p)) for p in parts], np.int32)


def features(gain: np.ndarray) -> list[float]:
    top = np.sort(gain)[::-1]
    n = len(top)
    return [top[0], top[:2].mean(), top[:4].mean(), top.mean(), (top > 0).mean(), (top > 2).mean(),
            np.log1p((top > 2).sum()), np.log1p((top > 4).sum()), np.log1p((top > 6).sum()), np.log(n)]


def _dictionary(size: int, parts: list[bytes]) -> bytes:
    """Trained dictionary content, or the distinct parts themselves when there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(parts))[-size:]


def _bare(parts: list[bytes]) -> list[bytes]:
    return [p[len(MARK):] for p in parts]


def _without_copies(texts: list[str], run: int = 8) -> list[str]:
    """Texts that share no run of eight words with an earlier one."""
    hasher, hashes, owners = Hasher(), [], []
    for first, end, data, at in blocks(pa.array(texts, pa.string())):
        words, offsets = hasher.words(data, at, lower=True)
        grams = hasher.windows(words, run)
        for d, lo, hi in zip(range(first, end), offsets[:-1], offsets[1:]):
            own = grams[lo:hi - run + 1] if hi - lo >= run else hasher.windows(words[lo:hi], hi - lo) if hi > lo else grams[:0]
            hashes.append(own)
            owners.append(np.full(len(own), d, np.int32))
    if not hashes:
        return []
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    first = owners[np.flatnonzero(new)][np.cumsum(new) - 1] if len(hashes) else owners
    copies = set(np.unique(owners[owners > first]).tolist())
    return [t for d, t in enumerate(texts) if d not in copies]


def train_dictionaries(ordinary: list[str], toxic: list[str], seed: int = 0) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    r = random.Random(seed)
    ordinary, toxic = _without_copies(ordinary), _without_copies(toxic)
    some = lambda x, n: r.sample(x, min(n, len(x)))
    halves = [[w for t in toxic[k::2] for w in windows(t)] for k in (0, 1)]
    pools = [some([w for t in ordinary[k::2] for w in windows(t)], 60_000) for k in (0, 1)]
    trained = _dictionary(ORDINARY_BYTES, some([w for t in ordinary for w in _bare(windows(t, 8))], 100_000))
    chosen, hard = [some(h, 30_000) for h in halves], []
    for _ in range(ROUNDS):
        base = trained + b"".join(_bare(hard))[-HARD_BYTES:]
        plain, picked, alike = compressor(base), [], []
        for k in (0, 1):
            c = compressor(base + b"".join(dict.fromkeys(_bare(chosen[1 - k])))[-(512 << 10):])
            gain = lengths(plain, halves[k]) - lengths(c, halves[k])
            chance = lengths(plain, pools[k]) - lengths(c, pools[k])
            cut = max(0.0, float(np.quantile(chance, RARE))) if len(chance) else 0.0
            picked.append([w for w, g in zip(halves[k], gain) if g > cut])
            alike += [w for w, g in zip(pools[k], chance) if g >= max(cut, 1)]
        hard = list(dict.fromkeys(hard + some(alike, 4000)))
        chosen = [p if len(p) > 20 else some(h, 2000) for p, h in zip(picked, halves)]
    base = trained + b"".join(_bare(hard))[-HARD_BYTES:]
    return base, base + _dictionary(TOXIC_BYTES, _bare(chosen[0] + chosen[1]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (intercept first) of a ridge logistic regression (Newton steps)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    """Dictionaries and calibration; small enough to go out with every task. ``threshold`` is the score that ``FALSE_SHARE`` of
    the calibrating texts of label 0 reach (one half where the score is a constant)."""

    def __init__(self, rows: list[tuple[int, str, int]], share: float):
        """``rows``: (identifier, text, label). A fifth of them calibrates, the rest trains.
        ``share``: of label 1 among all labelled rows, to which the calibration is shifted."""
        self.threshold = 0.5
        fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
        fit = [r for r in rows if not fold(r[0])]
        labels = {r[2] for r in fit}
        self.constant = None
        if labels != {0, 1}:
            self.constant = share
            return
        self.base, self.toxic = train_dictionaries([t for _, t, y in fit if not y], [t for _, t, y in fit if y])
        tune = [r for r in rows if fold(r[0])]
        if {r[2] for r in tune} != {0, 1}:
            tune = rows
        score = self.gains()
        y = np.array([float(r[2]) for r in tune])
        mean, scale, w = logistic(np.array([features(score(t)) for _, t, _ in tune]), y)
        w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        self.calibration = mean, scale, w
        rate = self.scorer()
        self.threshold = float(np.quantile([rate(t) for _, t, label in tune if not label], 1 - FALSE_SHARE))

    @classmethod
    def restored(cls, fields: dict) -> "Model":
        model = cls.__new__(cls)
        model.__dict__.update(fields)
        return model

    def gains(self):
        plain, toxic = compressor(self.base), compressor(self.toxic)

        def of(text: str | None) -> np.ndarray:
            parts = windows(text)
            return lengths(plain, parts) - lengths(toxic, parts)
        return of

    def scorer(self):
        if self.constant is not None:
            return lambda text: self.constant
        gains, (mean, scale, w) = self.gains(), self.calibration
        return lambda text: float(1 / (1 + np.exp(-(w[0] + ((np.array(features(gains(text))) - mean) / scale) @ w[1:]))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
                 doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    ids = F.col(doc_id).alias("_id")
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(ids, F.col(label).cast("int").alias("_y"))
             .dropDuplicates(["_id"]).where(~held_out("_id")))
    sizes = docs.select(ids, F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("_bytes")).join(known, "_id")
    chosen: list[int] = []
    for y in (0, 1):
        left = sample_bytes
        for row in sizes.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs).collect():
            if row["_bytes"] <= left:
                left -= row["_bytes"]
                chosen.append(row["_id"])
    picked = known.where(F.col("_id").isin(chosen)) if chosen else known.limit(0)
    rows = (docs.where(F.col(doc_id).isin(chosen) if chosen else F.lit(False)).select(ids, F.col(text).alias("_text"))
            .dropDuplicates(["_id"]).join(picked, "_id").select("_id", "_text", "_y"))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("_y")).first()
    share = (ones or 0) / max(n, 1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        model = Model(sorted(((i, t or "", y) for i, t, y in sample), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])), share)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model.__dict__)], pa.binary())})

    # the sample is bounded by the parameters: one task fits, and only the dictionaries and coefficients come back
    fitted = rows.repartition(1).mapInArrow(fit, "model binary").first()
    return Model.restored(pickle.loads(fitted["model"])) if fitted else Model([], share)


def toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row, from its whole text alone (a column that
    already has the name of the score is replaced)."""
    docs = docs.drop(score)
    position = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for b in batches:
            scores = pa.array([rate(t.as_py()) for t in b.column(position)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=names)

    return docs.mapInArrow(run, schema)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
