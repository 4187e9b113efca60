"""Array column functions: arg-max, softmax, one-hot, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(arr: Column) -> Column:
    """0-based index of the maximum; first index on ties (torch.max/argmax)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax(arr: Column) -> Column:
    """exp(x - max) / sum(exp(x - max)), numerically stable."""
    m = F.array_max(arr)
    e = F.transform(arr, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def join_numbers(arr: Column, sep: str = ",") -> Column:
    """Array of numbers as text (stable across engines for ints)."""
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)
