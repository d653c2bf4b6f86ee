"""All query keys. Importing the q_* modules fills the registry."""

from __future__ import annotations

from riskloom.plans import q_graph, q_models, q_prep, q_report, q_score, q_stream  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
