"""Running aggregates and neighbours within a key, safe for hot keys.

Normal keys use one plain window.  A key with more than ``hot_rows`` rows
(found by a count, so there are few of them) would be one huge task; its
order column is cut into range blocks (``o >> block_bits``), a window over
the small block table carries values across blocks and the final window runs
inside (key, block).  Keys and order values may be NULL: a NULL key is a key
like any other, NULL order values sort first and form a block of their own.
The order must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
HOT_ROWS = 1 << 20


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL equals NULL; the right side's copies of ``cols`` are dropped."""
    names = {c: f"_r_{c}" for c in cols}
    right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for c, r in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(r))
    return left.join(right, cond, how).drop(*names.values())


def _split_hot(df: DataFrame, part_cols: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of normal keys, and rows of keys with more than ``hot_rows`` rows; None where there is no such key.

    The hot keys, at most one in ``hot_rows`` rows, come from one count of the keys alone and return as a filter;
    without any the input is read once and the plan is a plain window.
    """
    hot = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > hot_rows).drop("_k").collect()
    if not hot:
        return df, None
    keys = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*part_cols).schema))
    return null_safe_join(df, keys, part_cols, "left_anti"), null_safe_join(df, keys, part_cols, "left_semi")


def _block(order_col: str, block_bits: int) -> Column:
    return F.shiftright(F.col(order_col).cast("bigint"), block_bits)


def running_agg(df: DataFrame, part_cols: list[str], order_col: str, value, fn: str = "sum",
                out: str = "running", total: str | None = None, block_bits: int = 16,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """``out`` = fn(value) over rows with order <= current.  ``total``
    optionally names fn over the whole partition key."""
    agg = _AGG[fn]
    x = df.withColumn("_v", F.col(value) if isinstance(value, str) else value)
    normal, hot = _split_hot(x, part_cols, hot_rows)
    whole = Window.partitionBy(*part_cols)
    upto = whole.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    normal = normal.withColumn(out, agg("_v").over(upto))
    if total:
        normal = normal.withColumn(total, agg("_v").over(whole))
    if hot is None:
        return normal.drop("_v")

    hot = hot.withColumn("_blk", _block(order_col, block_bits))
    blocks = hot.groupBy(*part_cols, "_blk").agg(agg("_v").alias("_bv"))
    before = Window.partitionBy(*part_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = blocks.select(*part_cols, "_blk", agg("_bv").over(before).alias("_prev"),
                         *([agg("_bv").over(Window.partitionBy(*part_cols)).alias(total)] if total else []))
    inner = Window.partitionBy(*part_cols, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    hot = null_safe_join(hot, offs, [*part_cols, "_blk"])
    within = agg("_v").over(inner)
    if fn == "sum":  # NULL only while no value was met, as in a plain window
        res = F.when(F.col("_prev").isNull(), within).otherwise(F.col("_prev") + F.coalesce(within, F.lit(0)))
    else:
        res = F.greatest(F.col("_prev"), within) if fn == "max" else F.least(F.col("_prev"), within)  # skip NULLs
    hot = hot.withColumn(out, res).drop("_blk", "_prev")
    return normal.unionByName(hot).drop("_v")


def lag_lead(df: DataFrame, part_cols: list[str], order_col: str, value: str, prev: str = "prev",
             nxt: str = "next", block_bits: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Previous / next ``value`` in ``order_col`` order within ``part_cols``.

    For hot keys lag/lead run inside (key, range block); the first row of a
    block takes the last value of the previous non-empty block and the last
    row the first value of the next one, from a per-block edge table.
    """
    normal, hot = _split_hot(df, part_cols, hot_rows)
    w = Window.partitionBy(*part_cols).orderBy(order_col)
    normal = normal.withColumns({prev: F.lag(value).over(w), nxt: F.lead(value).over(w)})
    if hot is None:
        return normal

    hot = hot.withColumn("_blk", _block(order_col, block_bits))
    # a block's order values are all NULL (one row) or none is: order by (is not NULL, value)
    place = F.struct(F.col(order_col).isNotNull(), F.col(order_col))
    edges = hot.groupBy(*part_cols, "_blk").agg(F.min_by(value, place).alias("_fv"), F.max_by(value, place).alias("_lv"))
    bw = Window.partitionBy(*part_cols).orderBy("_blk")
    edges = edges.select(*part_cols, "_blk", F.lag("_lv").over(bw).alias("_pl"), F.lead("_fv").over(bw).alias("_nf"))
    inner = Window.partitionBy(*part_cols, "_blk").orderBy(order_col)
    hot = hot.select("*", F.lag(value).over(inner).alias("_lag"), F.lead(value).over(inner).alias("_lead"),
                     F.row_number().over(inner).alias("_rn"),
                     F.count(F.lit(1)).over(Window.partitionBy(*part_cols, "_blk")).alias("_cnt"))
    hot = null_safe_join(hot, edges, [*part_cols, "_blk"])
    hot = hot.withColumn(prev, F.when(F.col("_rn") == 1, F.col("_pl")).otherwise(F.col("_lag"))) \
             .withColumn(nxt, F.when(F.col("_rn") == F.col("_cnt"), F.col("_nf")).otherwise(F.col("_lead"))) \
             .drop("_blk", "_lag", "_lead", "_rn", "_cnt", "_pl", "_nf")
    return normal.unionByName(hot)
