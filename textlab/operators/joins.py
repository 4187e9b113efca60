"""Skew-resistant equi-join for a large fact side and a keyed dimension.

Hot keys (each holding at least ``share`` of the fact rows, so at most
1/share of them) are found with one partially aggregated count and
collected; fact rows of hot keys get a deterministic salt from a hash of
their own columns (stable under task retries), and only the hot keys'
dimension rows are replicated once per salt.  Cold keys join as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    sc = df.sparkSession.sparkContext
    share = share or 1.0 / (4 * max(sc.defaultParallelism, 16))
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    # total as a scalar subquery: no single-partition window over all keys
    threshold = c.agg((F.sum("_c") * F.lit(share)).alias("_t")).scalar()
    return [r[key] for r in c.where(F.col("_c") >= threshold).limit(int(1 / share) + 1).collect()]


def hot_values(counts: DataFrame, key: str, n: str, share: float = 1.0 / 64) -> list:
    """Keys that hold at least ``share`` of a counted table's total: at most 1 / share."""
    total = counts.agg((F.sum(n) * F.lit(share)).alias("_t")).scalar()
    return [r[key] for r in counts.where(F.col(n) >= total).select(key).limit(int(1 / share) + 1).collect()]


def salted_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salt_cols: list[str],
                how: str = "inner", salts: int = 32, hot: list | None = None) -> DataFrame:
    """``big.join(small, big_key == small_key, how)`` with hot keys salted."""
    hot = hot_keys(big, big_key) if hot is None else hot
    if not hot or salts <= 1:
        return big.join(small, big[big_key] == small[small_key], how)
    b_hot = F.col(big_key).isin(hot)
    b = big.withColumn("_salt", F.when(b_hot, F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts)))
                       .otherwise(F.lit(0).cast("bigint")))
    s_hot = F.col(small_key).isin(hot)
    s = small.withColumn("_salt_s", F.explode(F.when(s_hot, F.sequence(F.lit(0).cast("bigint"),
                                                                        F.lit(salts - 1).cast("bigint")))
                                              .otherwise(F.array(F.lit(0).cast("bigint")))))
    j = b.join(s, (b[big_key] == s[small_key]) & (b["_salt"] == s["_salt_s"]), how)
    return j.drop("_salt", "_salt_s")
