"""Operators for large training-data pipelines (nothing else in textlab imports this)."""
