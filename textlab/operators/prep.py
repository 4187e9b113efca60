"""Corpus preparation: filters, recodes, majority vote with tie policies.

The vote runs as aggregations with map-side partial aggregation: (key, vote)
counts, then the top count of each key and its winners.  A key holding a
third of all rows is reduced to its distinct votes before the shuffle, and
only the winners of a key are ever put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def recode_map(col, mapping: dict, other=None) -> Column:
    """Set-membership recode: ``mapping`` value -> code; others keep ``other``
    (default: the input value, cast like the codes)."""
    c = _c(col)
    out = None
    for code, values in mapping.items():
        cond = c.isin(list(values))
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(other if other is not None else c)


def threshold_label(col, threshold) -> Column:
    """1 where value >= threshold else 0 (NULL stays NULL)."""
    c = _c(col)
    return F.when(c >= threshold, 1).when(c.isNotNull(), 0)


def band_filter(col, low, high) -> Column:
    """Keep values >= high or < low: drops the ambiguous band [low, high) and NULLs."""
    c = _c(col)
    return (c >= high) | (c < low)


def recode_override(num, k) -> Column:
    """Ordered recode with override, in the reference's write order:
    num 1->0, 2->1, 3->2, 4->2, others unchanged; then k in {1,2} forces 1
    (also where num is NULL).  The override is written last, so it wins."""
    n, kk = _c(num), _c(k)
    return (F.when(kk.isin(1, 2), F.lit(1))
            .when(n == 1, 0).when(n == 2, 1).when(n.isin(3, 4), 2)
            .otherwise(n))


def not_missing(col) -> Column:
    """Not NULL and, for floating columns, not NaN."""
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c)


def vote_modes(df: DataFrame, key_cols: list[str], vote_col: str) -> DataFrame:
    """All modes per key: (key..., modes ARRAY sorted, n_modes, n_votes).

    NULL votes are ignored; keys with a NULL part are dropped (pandas
    groupby); a key with only NULL votes keeps an empty ``modes``.
    """
    cond = F.lit(True)
    for k in key_cols:
        cond = cond & F.col(k).isNotNull()
    cells = df.where(cond).groupBy(*key_cols, F.col(vote_col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("v").isNotNull(), F.col("n"))
    tops = cells.groupBy(*key_cols).agg(F.max(n).alias("top"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_votes"))
    won = cells.where(F.col("v").isNotNull()).withColumnRenamed("n", "top")
    # only the winners are put into the array, which is the result
    modes = won.join(tops, [*key_cols, "top"]).groupBy(*key_cols).agg(F.array_sort(F.collect_list("v")).alias("modes"))
    none = F.array().cast(modes.schema["modes"].dataType)
    return tops.join(modes, key_cols, "left").select(
        *key_cols, F.coalesce("modes", none).alias("modes"),
        F.coalesce(F.size("modes"), F.lit(0)).alias("n_modes"), "n_votes")


def vote_winner(df: DataFrame, key_cols: list[str], vote_col: str) -> DataFrame:
    """(key..., n_modes, winner): how many votes tie at the top, and the least of them; no array is built."""
    cond = F.lit(True)
    for k in key_cols:
        cond = cond & F.col(k).isNotNull()
    cells = df.where(cond).groupBy(*key_cols, F.col(vote_col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0).alias("n")
    ties = cells.select(*key_cols, "v", n).groupBy(*key_cols, "n").agg(
        F.count("v").cast("int").alias("n_modes"), F.min("v").alias("winner"))
    top = ties.groupBy(*key_cols).agg(F.max(F.struct("n", "n_modes", "winner")).alias("t"))
    return top.select(*key_cols, "t.n_modes", "t.winner")


def vote_keep_ties(df: DataFrame, key_cols: list[str], vote_col: str) -> DataFrame:
    """Tie policy *keep*: the sorted mode array leaks through."""
    return vote_modes(df, key_cols, vote_col)


def vote_drop_ties(df: DataFrame, key_cols: list[str], vote_col: str, out: str = "label") -> DataFrame:
    """Tie policy *drop*: keys with more than one mode are removed."""
    m = vote_winner(df, key_cols, vote_col)
    return m.where(F.col("n_modes") == 1).select(*key_cols, F.col("winner").alias(out))


def vote_neutral(df: DataFrame, key_cols: list[str], vote_col: str, neutral=0, out: str = "label",
                 codes: list | None = None) -> DataFrame:
    """Tie policy *neutral*: a tie, no vote, or a winner that is none of ``codes`` becomes ``neutral``."""
    m = vote_winner(df, key_cols, vote_col)
    clear = F.col("n_modes") == 1
    if codes is not None:
        clear = clear & F.col("winner").isin(list(codes))
    return m.select(*key_cols, F.when(clear, F.col("winner")).otherwise(F.lit(neutral)).alias(out))


def binary_from_polar(df: DataFrame, label: str = "label", neutral=0, negative=-1) -> DataFrame:
    """Drop the neutral class, then map negative -> 0 (positive stays 1)."""
    return df.where(F.col(label) != neutral).withColumn(
        label, F.when(F.col(label) == negative, F.lit(0)).otherwise(F.col(label)))


def vote_by_text(df: DataFrame, text: str, vote_col: str, clean: Callable[[Column], Column], clean_first: bool = True,
                 out: str = "label") -> DataFrame:
    """(text, label): one row per text, its clear vote; tied and voteless texts go.

    ``clean_first`` groups by the cleaned text, so that texts which differ only in what cleaning removes are one.
    Otherwise texts are grouped as they are and cleaned afterwards, and copies that cleaning makes alike survive.
    Groups meet by a digest; a group's text travels once for each task that has it, not once a row.
    """
    own = df.where(F.col(text).isNotNull()).select((clean(F.col(text)) if clean_first else F.col(text)).alias("_text"), vote_col)
    own = own.withColumn("_key", F.sha2("_text", 256))
    texts = own.groupBy("_key").agg(F.any_value("_text").alias("_text"))
    won = vote_drop_ties(own, ["_key"], vote_col, out).join(texts, "_key")
    return won.select((F.col("_text") if clean_first else clean(F.col("_text"))).alias(text), out)


def drop_first_group(df: DataFrame, key_cols: list[str], positional: bool = False,
                     text_col: str | None = None) -> DataFrame:
    """Drop the group of the empty text (``text_col``, by default the first key).

    ``positional=True`` drops the first group in key order instead, whatever it is (the reference's ``iloc[1:]``):
    the minimum key is found with one aggregate (a single row) and anti-joined.
    """
    if not positional:
        return df.where(F.col(text_col or key_cols[0]) != "")
    first = df.agg(F.min(F.struct(*key_cols)).alias("k")).select(*[F.col(f"k.{c}").alias(c) for c in key_cols])
    return df.join(F.broadcast(first), key_cols, "left_anti")  # one row


def flatten_modes(col="modes", sep: str = "|") -> Column:
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)
