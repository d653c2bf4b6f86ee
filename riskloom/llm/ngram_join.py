"""Operator 6: Jaccard join on word shingles by vertical partitioning.

The global order of shingles is rare first: shingles counted often within blocks of documents (the
``FREQUENT`` most counted of the corpus) come last, by their counts; all others come before them in
hash order. Two sets with a Jaccard similarity of t share a shingle among the first
n - ceil(t n) + 1 of each, so only those prefixes are compared. Prefix shingles of one document only
are sieved out first (chunks of documents send their distinct hashes to buckets of the hash range and
get a bit for each that another chunk has), and documents with equal sets are taken together.

Candidates of one shingle are paired in stars: all with the smallest identifier, then, where the
found links leave several groups, all with the smallest of every group, and at last every pair that
is left between different groups; so a large group of copies costs its size, and no link between
groups is lost. A shared shingle that isn't in both prefixes lies beyond the prefix that ends first, so pairs whose prefixes share too
few for the similarity are dropped before any text is fetched. To verify, the candidates' shingles are cut into fragments of the hash range; the
overlaps of each fragment are counted separately and summed per pair. Links make components.

Shingles are 64-bit hashes; two different ones are taken for equal with probability 2^-64.

Defined results: rows without words, or null text, have no shingles and no links; fewer than five
words are one shingle; rows that share an identifier are one document (linked through any of them);
rows without an identifier have no links and no component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved, table
from riskloom.llm.tokens import Hasher, blocks, bucket_cuts, deltas, from_deltas, utf8
from riskloom.operators.graph import connected_components
from riskloom.session import checkpoint_dir, dropping_shuffles

WORDS, PERCENT, FRAGMENTS = 5, 80, 4
FREQUENT, OFTEN = 1 << 17, 4
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
NO_ID = 1 << 62
STAR, GROUP, COUNTED = 128, 256, 2_000_000


class Shingler:
    def __init__(self, words: int = WORDS):
        self.k, self.hasher = words, Hasher()

    def sets(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        words, offsets = self.hasher.words(data, at, lower=True)
        grams = self.hasher.windows(words, self.k)
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            if hi - lo >= self.k:
                g = np.sort(grams[lo:hi - self.k + 1])
                yield g[np.append(True, g[1:] != g[:-1])]
            else:
                yield self.hasher.windows(words[lo:hi], hi - lo) ^ np.uint64(hi - lo) if hi > lo else grams[:0]


def prefix(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of a set in the global order."""
    n = len(grams)
    size = n - (percent * n + 99) // 100 + 1 if n else 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        often = frequent[at] == grams
        if often.any():
            late = grams[often][np.lexsort((grams[often], rank[at[often]]))]
            return np.concatenate([grams[~often], late])[:size]
    return grams[:size]


def frequent_shingles(docs: DataFrame, words: int, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the most counts within blocks of documents and their ranks (rarest first). Counts
    cover all documents; only the order of the shingles, never a result, depends on them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            held = []
            for _, end, data, at in blocks(b.column(0)):
                held += shingler.sets(data, at)
                if end == len(b) or sum(map(len, held)) > COUNTED:
                    gram, n = np.unique(np.concatenate(held), return_counts=True)
                    often, held = n >= OFTEN, []
                    yield pa.record_batch({"gram": gram[often].view(np.int64), "n": n[often]})

    top = (docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "gram").limit(limit).toPandas())
    gram = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], (len(gram) - 1 - np.arange(len(gram)))[order]


def prefixes(docs: DataFrame, words: int, percent: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """``doc_id, n, digest, grams, places``: size and digest of each set, and those of its prefix
    shingles that another document has in its prefix, with their places in the prefix."""
    total, mean = docs.agg(F.sum(F.octet_length("text")), F.avg(F.octet_length("text"))).first()
    width = max(1, int(chunk_bytes / max(mean or 1, 1)))
    buckets = max(4, -(-int(total or 0) // bucket_bytes))
    chunks = max(1, -(-int(total or 0) // chunk_bytes))
    rows = docs.select(F.coalesce(F.expr(f"doc_id div {width}"),
                                  F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(chunks))).alias("chunk"), "doc_id", "text")
    frequent, rank = frequent_shingles(docs, words)

    def chunk_of(rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, at = utf8(rows["text"])
        sets = list(Shingler(words).sets(data, at))
        ids = rows["doc_id"].to_pylist()
        first = [prefix(s, frequent, rank, percent) if i is not None else s[:0] for i, s in zip(ids, sets)]
        gram, n = np.unique(np.concatenate(first), return_counts=True)
        return ids, sets, first, gram, n

    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        *_, gram, _ = chunk_of(rows)
        cuts = bucket_cuts(gram, buckets)
        filled = np.flatnonzero(cuts[1:] > cuts[:-1])
        return pa.table({"bucket": pa.array(filled, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(filled), pa.int64()),
                         "hashes": pa.array([deltas(gram[cuts[b]:cuts[b + 1]]) for b in filled], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = [from_deltas(x.as_buffer()) for x in rows["hashes"]]
        gram, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        bits = np.split(n[at] > 1, np.cumsum([len(p) for p in parts])[:-1])
        hit = [i for i, b in enumerate(bits) if b.any()]
        return pa.table({"chunk": pa.array(rows["chunk"].to_numpy()[hit], pa.int64()),
                         "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()),
                         "bits": pa.array([np.packbits(bits[i]).tobytes() for i in hit], pa.binary())})

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sets, first, gram, n = chunk_of(rows)
        shared, cuts = n > 1, bucket_cuts(gram, buckets)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"]):
            lo, hi = cuts[b], cuts[b + 1]
            shared[lo:hi] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo).astype(bool)
        places = [np.flatnonzero(shared[np.searchsorted(gram, f)]) for f in first]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                         "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                         "grams": pa.array([f[p].view(np.int64) for f, p in zip(first, places)], pa.list_(pa.int64())),
                         "places": pa.array(places, pa.list_(pa.int64()))})

    sent = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, bits binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        keep, "doc_id long, n long, digest binary, grams array<long>, places array<long>")


def _possible(percent: int):
    """Sizes and the places of a common prefix shingle allow the similarity."""
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` that the common shingles of their prefixes (``sets``: ``doc_id, n, grams``) allow to link, by any of their
    texts. Of a set's n shingles ceil(t n) - 1 lie beyond its prefix."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    beyond = F.expr(f"({percent} * greatest(na, nb) + 99) div 100 - 1")
    most = F.size(F.array_intersect("ga", "gb")) + beyond
    return (pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
            .where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct())


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int, fragments: int,
             broadcast_rows: int = 500_000) -> DataFrame:
    """The ``a, b`` of ``pairs`` that link. Partners of one ``a`` are cut into stars
    of bounded size; the whole texts of both sides are fetched and their shingles cut into fragments; the
    overlaps of each fragment are counted on their own and summed per pair."""
    # aggregates are saved before they meet their rows again, so that joins on hot keys can be split
    stars = saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("stars")), "join-stars")
    placed = saved(pairs.join(stars, "a").withColumn("star", F.pmod(F.xxhash64("b"), F.col("stars"))), "join-pairs")
    centres = (placed.select("a", "stars").distinct()
               .select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("stars") - 1)).alias("star")))
    roles = placed.select(F.col("b").alias("doc_id"), "a", "star").unionByName(centres)
    size = roles.count()
    if not size:
        return placed.select("a", "b")
    groups = -(-size // GROUP)
    roles = roles.withColumn("grp", F.pmod(F.xxhash64("a", "star"), F.lit(groups)))
    texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(roles) if size <= broadcast_rows else roles, "doc_id")

    def overlaps(rows: pa.Table) -> pa.Table:
        shingler, centre, members = Shingler(words), {}, []
        keys = list(zip(*(rows[c].to_pylist() for c in ("a", "star", "doc_id"))))
        for first, end, data, at in blocks(rows["text"]):
            for (a, star, d), s in zip(keys[first:end], shingler.sets(data, at)):
                cuts = bucket_cuts(s, fragments)
                whole = (int(np.bitwise_xor.reduce(s).view(np.int64)), [s[x:y] for x, y in zip(cuts[:-1], cuts[1:])])
                centre.setdefault((a, star), []).append(whole) if a == d else members.append((a, star, d, whole))
        found = [(a, u, d, t, len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q))
                 for a, star, d, (t, parts) in members for u, own in centre[a, star] for p, q in zip(own, parts)]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(6)], ["a", "u", "b", "t", "same", "both"])

    partial = (texts.select("grp", "a", "star", "doc_id", "text")
               .groupBy("grp").applyInArrow(overlaps, "a long, u long, b long, t long, same long, both long"))
    # the tags tell apart different texts under one identifier
    summed = partial.groupBy("a", "u", "b", "t").agg(F.sum("same").alias("same"), F.sum("both").alias("both"))
    return summed.where((100 + percent) * F.col("same") >= percent * F.col("both")).select("a", "b").distinct()


def _with_several(posted: DataFrame, column: str) -> DataFrame:
    """Postings of the shingles that have more than one value of ``column``."""
    grams = (posted.groupBy("gram").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo < hi").select("gram"))
    return saved(posted.join(saved(grams, "join-grams"), "gram"), "join-postings")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS,
               doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
               bucket_bytes: int = BUCKET_BYTES, star_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``. Every step is stored, and its shuffle files go with its end."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    with dropping_shuffles(spark):
        return _joined(docs, words, percent, fragments, doc_id, text, chunk_bytes, bucket_bytes, star_rounds)


def _joined(docs: DataFrame, words: int, percent: int, fragments: int, doc_id: str, text: str, chunk_bytes: int, bucket_bytes: int,
            star_rounds: int) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = saved(prefixes(docs, words, percent, chunk_bytes, bucket_bytes), "join-prefixes")
    some = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = saved(some.groupBy("n", "digest").agg(F.min("doc_id").alias("first")), "join-classes")
    of_class = some.select("doc_id", "n", "digest").join(classes, ["n", "digest"])

    sets = saved(some.join(classes.select("digest", F.col("first").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"])
                 .select("doc_id", "n", "grams", "places"), "join-sets")
    posted = (sets.select("doc_id", "n", F.explode(F.arrays_zip("grams", "places")).alias("g"))
              .select(F.col("g.grams").alias("gram"), "doc_id", "n", F.col("g.places").alias("place")))
    posted = _with_several(posted, "doc_id")

    links = tested = None
    rest = posted.withColumn("label", F.col("doc_id"))
    for step in range(star_rounds + 1):
        one = rest.select("gram", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"))
        two = rest.select("gram", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"))
        last = step == star_rounds
        heads = one
        if not last:
            by = ["gram"] if step == 0 else ["gram", "la"]
            heads = saved(one.groupBy(*by).agg(F.min(F.struct("a", "na", "pa", "la")).alias("h")).select("gram", "h.*"), "join-heads")
        met = heads.join(two, "gram").where((F.col("a") != F.col("b")) & (F.col("la") < F.col("lb") if last else F.col("la") != F.col("lb"))
                                            & _possible(percent))
        swap = F.col("a") > F.col("b")
        pairs = met.select(F.least("a", "b").alias("a"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
                           F.greatest("a", "b").alias("b"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, "join-candidates")
        likely = saved(overlapping(pairs, sets, percent), "join-likely")
        found = saved(verified(docs, likely, words, percent, fragments), "join-links")
        links = found if links is None else links.unionByName(found)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        if not last:
            # a head has met all others of its shingle; what is left there goes on, under the groups found so far
            groups = saved(connected_components(links, "a", "b"), "join-groups").select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
            rest = (rest.drop("label").join(heads.select("gram", F.col("a").alias("doc_id")), ["gram", "doc_id"], "left_anti")
                    .join(groups, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
            rest = _with_several(saved(rest, "join-rest"), "label")

    # different texts of one identifier belong together
    own = of_class.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").drop("b")
    links = links.unionByName(of_class.join(own, "doc_id").where("a < first").select("a", F.col("first").alias("b")))
    components = saved(connected_components(links, "a", "b"), "join-components")
    grouped = (of_class.join(components, of_class["first"] == components["node"], "left")
               .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id")))
    alone = base.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
