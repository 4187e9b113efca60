"""All registered queries and their oracles (importing registers them)."""

from __future__ import annotations

from textlab.plans import q_eval, q_features, q_io, q_models, q_prep, q_sampling, q_zeroshot  # noqa: F401
from textlab.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
