"""All query keys of the subpackage."""

from __future__ import annotations

from riskloom.llm import collocations, decontamination, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, pii, secrets, substring_dedup, token_alignment, toxicity, warc  # noqa: F401
from riskloom.llm.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
