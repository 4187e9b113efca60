"""Seeded, exact-size, partition-independent sampling.

Every random choice is an md5 draw of ``seed:...`` (see functions.random),
so results do not depend on partitioning, task retries or executor loss,
and an SQL engine can reproduce them exactly.

Exact ranks without a single-partition window: rows are bucketed by the
first hex digits of their hash; bucket counts (at most 16^digits per
group, a bound set by the parameter, not by the data) give offsets through
a small window, the offsets are broadcast, and ``row_number`` runs inside
(group, bucket) partitions.  md5 spreads a hot group evenly over buckets,
so even a group with a third of all rows is split into 65536 tasks' worth
of window partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.random import draw, hash_key

STRATEGIES = ("upsampling", "undersampling", "loss_weight", "none")
#: Draws that one row of the draw plan generates.
DRAWS = 100_000


def seeded_rank(df: DataFrame, seed, key: str, by: list[str] = (), bucket_digits: int = 4,
                out: str = "pos", total: str | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in the seeded permutation
    of its ``by`` group (order: md5(seed:key), then key).  ``total`` names an
    optional column with the group size.

    The bucket-offset table has at most 16^bucket_digits rows per group; it
    is broadcast without ``by`` (one group: a bound set by the parameter);
    otherwise the join strategy is left to the optimizer's sizes."""
    if not 1 <= bucket_digits <= 5:
        raise ValueError("bucket_digits must be in 1..5 (broadcast bound 16^digits rows per group)")
    by = list(by)
    x = df.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, bucket_digits))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b")
    offs = counts.select(
        *by, "_b",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_tot"))
    r = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = x.join(offs if by else F.broadcast(offs), [*by, "_b"]).withColumn(
        out, (F.col("_off") + F.row_number().over(r) - 1).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("_tot").cast("bigint"))
    return ranked.drop("_h", "_b", "_off", "_tot")


def holdout(df: DataFrame, seed, key: str, n: int, out: str = "pos") -> DataFrame:
    """Exactly ``n`` rows without replacement, in shuffled order.

    Plans as TakeOrderedAndProject: each partition keeps its own top n and
    only n rows per partition are merged, whatever the input size.
    """
    h = df.withColumn("_h", hash_key(seed, F.col(key)))
    top = h.orderBy("_h", key).limit(n)
    w = Window.orderBy("_h", key)  # over the n kept rows only
    return top.withColumn(out, (F.row_number().over(w) - 1).cast("bigint")).drop("_h")


def holdout_keys(df: DataFrame, seed, key: str, n: int) -> DataFrame:
    """Only the keys of ``holdout`` (what a complement needs): the top-n
    carries one column, not whole rows."""
    h = df.select(key).withColumn("_h", hash_key(seed, F.col(key)))
    return h.orderBy("_h", key).limit(n).select(key)


def complement(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken`` (left anti join; the optimizer sizes it)."""
    return df.join(taken.select(key), key, "left_anti")


def split_train_val(df: DataFrame, seed, key: str, train_frac: float = 0.9, out: str = "split") -> DataFrame:
    """Exact-size, unstratified split: ``int(train_frac * n)`` train rows,
    the rest (the first ones in the seeded order) validation."""
    r = seeded_rank(df, seed, key, total="_n")
    n_train = F.floor(F.lit(float(train_frac)) * F.col("_n"))
    return r.withColumn(out, F.when(F.col("pos") < F.col("_n") - n_train, F.lit("val")).otherwise(F.lit("train"))) \
            .drop("_n")


def resample(df: DataFrame, seed, key: str, label: str, strategy: str, by: list[str] = ()) -> DataFrame:
    """Per-class resampling with replacement (the reference's semantics).

    upsampling: every class draws max-class-count rows, the majority class
    too (bootstrap); undersampling: min-class-count draws, also with
    replacement; loss_weight / none: rows unchanged.  Output adds ``i``
    (draw number within the class).  Draw i of class c is row
    ``md5(seed:group:c:i) mod n_c`` of the class's seeded permutation, so
    it is an equi-join between generated draw numbers and ranked rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imbalance strategy {strategy!r}; use one of {STRATEGIES}")
    by = list(by)
    if strategy in ("loss_weight", "none"):
        return df.withColumn("i", F.lit(None).cast("bigint"))
    df = df.where(F.col(label).isNotNull())  # a row without a class cannot be rebalanced
    most = F.max if strategy == "upsampling" else F.min
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # over one row per class
    classes = (df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_nc"))
               .withColumn("_draws", most("_nc").over(groups)))
    # a class's draws in runs of DRAWS, dealt out before they are generated
    runs = classes.select(*by, label, "_nc", "_draws", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("_draws") - 1, F.lit(DRAWS).cast("bigint"))).alias("_at"))
    runs = runs.repartition(*by, label, "_at")
    draws = runs.select(*by, label, "_nc", F.explode(F.sequence(
        F.col("_at"), F.least(F.col("_at") + DRAWS, F.col("_draws")) - 1)).alias("i"))
    names = {c: f"_d_{c}" for c in [*by, label]}
    draws = draws.withColumn("_dpos", draw(seed, *[F.col(c) for c in by], F.col(label), F.col("i")) % F.col("_nc"))
    draws = draws.withColumnsRenamed(names).drop("_nc")
    ranked = seeded_rank(df, seed, key, by=[*by, label])
    cond = F.col("pos") == F.col("_dpos")
    for c, d in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(d))
    return draws.join(ranked, cond).select(*df.columns, "i")


def subset_sizes(df: DataFrame, seed, key: str, sizes: list[int], n: int | None = None) -> DataFrame:
    """Training-size subsets drawn with replacement from one draw stream:
    draw i picks row ``md5(seed:size:i) mod n``; the set of size N is draws
    0..N-1, so smaller sets are prefixes of larger ones.  Adds n_train, i.
    ``n`` (the row count) may be passed when the caller already knows it."""
    spark = df.sparkSession
    n = df.count() if n is None else n
    m = max(sizes) if n > 0 else 0  # nothing to draw from: empty result
    d = spark.range(0, m, 1, max(1, min(spark.sparkContext.defaultParallelism, m // 100_000 + 1))) \
        .select(F.col("id").alias("i"))
    d = d.withColumn("pos", draw(seed, F.lit("size"), F.col("i")) % F.lit(max(n, 1)))
    ranked = seeded_rank(df, seed, key)
    j = d.join(ranked, "pos").drop("pos")
    sz = F.array(*[F.lit(int(s)).cast("bigint") for s in sorted(sizes)])
    return j.withColumn("n_train", F.explode(F.filter(sz, lambda s: F.col("i") < s)))


def size_bands(df: DataFrame, seeds: list[int], rank_seed, key: str, sizes: list[int], n: int) -> DataFrame:
    """(seed, band, key, m): the draws of ``subset_sizes`` of many seeds, each counted once in the band where it
    enters.  Band b holds draws sizes[b-1]..sizes[b]-1 of a seed's one stream, so the set of size b is the sum of
    bands 0..b: statistics of all sizes are running sums over bands, without a copy of the rows per size."""
    spark = df.sparkSession
    sizes = sorted(int(x) for x in sizes)
    m = sizes[-1] if n > 0 else 0
    seed = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in seeds]))
    d = spark.range(0, m, 1, max(1, min(spark.sparkContext.defaultParallelism, m // 100_000 + 1)))
    d = d.select(F.col("id").alias("i"), seed.alias("seed"))
    band = F.size(F.filter(F.array(*[F.lit(x) for x in sizes]), lambda x: x <= F.col("i")))
    d = d.select("seed", band.alias("band"), (draw(F.col("seed"), F.lit("size"), F.col("i")) % F.lit(max(n, 1))).alias("pos"))
    d = d.groupBy("seed", "band", "pos").agg(F.count(F.lit(1)).alias("m"))
    return d.join(seeded_rank(df.select(key), rank_seed, key), "pos").select("seed", "band", key, "m")


def weight_rows(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Attach the class weight to every row.  The weight table has one row
    per class and is broadcast: dealt by label, all rows of a class (and
    their texts) would go to one task, before AQE knows any size."""
    return df.join(F.broadcast(weights.select(label, "w")), label, "left")
