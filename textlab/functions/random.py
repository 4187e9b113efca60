"""Seeded, partition-independent random draws.

A row's draw is the md5 of ``seed:key...``; ordering by that string is a
seeded permutation and its first 8 hex digits are a 32-bit integer draw.
Unlike ``rand(seed)`` the result does not depend on partitioning, so it is
stable under executor loss, re-planning and repartitioning, and any SQL
engine with md5 can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(parts) -> list[Column]:
    return [p if isinstance(p, Column) else F.lit(p) for p in parts]


def hash_key(*parts) -> Column:
    """md5 hex of the ':'-joined parts (Columns or literals)."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in _cols(parts)]))


def draw(*parts) -> Column:
    """Integer draw in [0, 2^32): first 8 hex digits of ``hash_key``."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")
