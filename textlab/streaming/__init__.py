"""Structured Streaming entry points.

The pipeline's per-row operators (text cleaning, lexicon / pluggable
scoring, label mapping) are stateless column logic, so they run unchanged
on a streaming DataFrame; results go to a sink through ``foreachBatch``
(idempotent per batch id) or any built-in streaming sink.
"""

from textlab.streaming.score import score_stream  # noqa: F401
