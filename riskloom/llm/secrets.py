"""Operator 7: secret scans through a trigram index.

Each rule's pattern is turned into a Boolean query over trigrams that every match must hold: an OR of
ANDs, taken from the parsed pattern (ASCII case folded). The index keeps, for the trigrams that occur
in any query, postings of the documents that hold them; postings are joined with the queries and
intersected per document in Spark. Only candidate documents are verified by a rule's pattern; a rule
for which some alternative has no trigram (the hex rule) scans every text.

Base rules: assign, access, hex (leftmost non-overlapping matches; those that fail the length check
are dropped). The other rules add spans and leave those of the base as they are.

Defined results: null text is empty and has no spans; offsets are code points, end exclusive; repeated
rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved, table
from riskloom.llm.tokens import blocks


class Rule(NamedTuple):
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0          # whose length counts
    least: int = 0
    base: bool = False


# Kinds and patterns in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.ASCII | re.IGNORECASE, 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 18, True),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 16, True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
ALTERNATIVES = 64


def _alternatives(parsed) -> list[list[str | None]]:
    """A pattern as alternatives of pieces: folded characters, and None where anything may stand."""
    out: list[list[str | None]] = [[]]
    for op, value in parsed:
        if op is sre.LITERAL:
            options = [[chr(value).lower()]] if value < 128 else [[None]]
        elif op is sre.IN:
            chars = {chr(v).lower() for o, v in value if o is sre.LITERAL and v < 128}
            small = len(chars) <= 5 and all(o is sre.LITERAL and v < 128 for o, v in value)
            options = [[c] for c in sorted(chars)] if small else [[None]]
        elif op is sre.SUBPATTERN:
            options = _alternatives(value[3])
        elif op is sre.BRANCH:
            options = [a for branch in value[1] for a in _alternatives(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                options = [[], *_alternatives(inner)]
            else:
                options = [a + [None] for a in _alternatives(inner)] if least else [[None]]
        else:
            options = [[None]]
        if len(out) * len(options) > ALTERNATIVES:
            options = [[None]]
        out = [a + b for a in out for b in options]
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """Sets of trigrams of which a match holds at least one whole set; None if a match may hold none.
    A single space may be any number of them where the pattern says so, so gaps break trigrams."""
    found = []
    for pieces in _alternatives(sre_parser.parse(rule.pattern, rule.flags)):
        runs = "".join(c if c is not None else "\0" for c in pieces).split("\0")
        trigrams = frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2))
        if not trigrams:
            return None
        found.append(trigrams)
    return [q for q in set(found) if not any(p < q for p in found)]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``key, trigram`` of the given trigrams (folded) that each text of ``docs`` (``key, text``) holds."""
    codes = np.array([(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]) for t in trigrams], np.int64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << 24, -1, np.int16)
        number[codes] = np.arange(len(codes))
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, at in blocks(b.column(1)):
                folded = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.int32)
                if len(folded) < 3:
                    continue
                which = number[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
                place = np.flatnonzero(which >= 0)
                doc = np.searchsorted(at, place, "right") - 1
                whole = place + 3 <= at[doc + 1]
                pair = np.unique(doc[whole] * len(codes) + which[place[whole]])
                yield pa.record_batch({"key": keys[first + pair // len(codes)], "trigram": (pair % len(codes)).astype(np.int32)})

    return docs.select("key", "text").mapInArrow(index, "key long, trigram int")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, rules``: the numbers of the indexed rules whose query the document meets."""
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r)) is not None}
    vocabulary = sorted({t for q in queries.values() for s in q for t in s})
    terms = [(vocabulary.index(t), n, a, len(s)) for n, q in queries.items() for a, s in enumerate(q) for t in sorted(s)]
    terms = docs.sparkSession.createDataFrame(terms, "trigram int, rule int, alternative int, need int")
    met = (postings(docs, vocabulary).distinct().join(F.broadcast(terms), "trigram")      # as large as the rules
           .groupBy("key", "rule", "alternative", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans(text: str, rules: tuple[Rule, ...], patterns: list[re.Pattern], which: list[int]) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of the matches long enough, in order."""
    return sorted((m.start(), n, m.end()) for n in which for m in patterns[n].finditer(text)
                  if m.end(rules[n].group) - m.start(rules[n].group) >= rules[n].least)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text",
                broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, a count ``n_<kind>`` per base rule, ``base_sha256`` and
    ``spans``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.xxhash64(doc_id).alias("key"))
    met = saved(candidates(rows, rules), "secret-candidates")
    joined = rows.join(F.broadcast(met) if met.count() <= broadcast_rows else met, "key", "left").select("doc_id", "text", "rules")
    base = [n for n, r in enumerate(rules) if r.base]
    names = [f"n_{rules[n].kind}" for n in base]
    always = [n for n, r in enumerate(rules) if trigram_query(r) is None]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern, r.flags) for r in rules]
        line = lambda found: ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in found)
        for b in batches:
            out: list[list] = [[] for _ in range(len(names) + 2)]
            for t, more in zip(b.column(1), b.column(2)):
                found = spans(t.as_py(), rules, patterns, sorted({*always, *(more.as_py() or ())}))
                plain = [f for f in found if rules[f[1]].base]
                for column, n in zip(out, base):
                    column.append(sum(f[1] == n for f in plain))
                out[-2].append(hashlib.sha256(line(plain).encode()).hexdigest())
                out[-1].append(line(found))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:-2]),
                                              *(pa.array(c, pa.string()) for c in out[-2:])], ["doc_id", *names, "base_sha256", "spans"])

    return joined.mapInArrow(verify, ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_sha256 string", "spans string"]))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
