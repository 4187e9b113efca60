"""Dense numbers for ordered values without a window over all of them.

Values are sorted by range, each range in its own task; a row's number is
the count of all ranges before its own plus its place in its range.  Only
the counts, one for each task, come to the driver and go back as a table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.session import cut_lineage


def place_in_task() -> Column:
    """0, 1, 2, ... within the rows of a task, in their order."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def prefix_table(df: DataFrame, key: str, counts: dict, before: str = "_before") -> DataFrame:
    """(key, before): the sum of the counts of all smaller keys; one row a task (or file), so it is broadcast."""
    keys = sorted(counts)
    sums = accumulate((counts[k] for k in keys[:-1]), initial=0) if keys else ()
    schema = df.select(key, F.lit(0).cast("bigint").alias(before)).schema
    return F.broadcast(df.sparkSession.createDataFrame(list(zip(keys, sums)), schema))


def dense_index(values: DataFrame, col: str, out: str = "idx", total: str = "k") -> DataFrame:
    """(col, out, total) of the distinct values that are not NULL: 0-based place in their order, and their number."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    ordered = distinct.repartitionByRange(col).sortWithinPartitions(col)
    # stored, so that the counts and the rows come from the same cut into ranges
    ranged = cut_lineage(ordered.select(col, F.spark_partition_id().alias("_range"), place_in_task().alias("_place")))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row a task
    k = sum(counts.values())
    return ranged.join(prefix_table(ranged, "_range", counts), "_range").select(
        col, (F.col("_before") + F.col("_place")).cast("int").alias(out), F.lit(k).cast("int").alias(total))
