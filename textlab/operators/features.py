"""Label indexing and model-input features, as column expressions.

Classes are a table (label, idx, k) that rows are joined with, so their
number needs no bound; per-row work stays in JVM expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.random import draw
from textlab.functions.text import tokens
from textlab.operators.ranks import dense_index

# --- fixed values: special token ids and default sizes of the encoder ---
PAD_ID, CLS_ID, SEP_ID = 0, 1, 2
FIRST_TOKEN_ID = 3
VOCAB = 30000


def class_index(df: DataFrame, label: str) -> DataFrame:
    """(label, idx, k): sorted distinct classes, idx 0..k-1 (the one-hot order); any number of them."""
    return dense_index(df, label)


def with_index(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """``df`` with the 0-based class id ``idx`` and the class count ``k``; unknown labels get NULL."""
    return df.join(classes, label, "left")


def index_labels(label: str, classes: list) -> Column:
    """0-based class id of ``label`` given a class list that is a parameter; unknown -> NULL."""
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    return F.when(pos > 0, (pos - 1).cast("int"))


def inverse_labels(idx: Column, classes: list) -> Column:
    """class id -> label, given a class list that is a parameter."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), idx + 1)


def token_ids(toks: Column, vocab: int = VOCAB, salt: str = "0") -> Column:
    """Hashed word ids in [FIRST_TOKEN_ID, FIRST_TOKEN_ID + vocab)."""
    return F.transform(toks, lambda t: draw(F.lit(salt), t) % vocab + FIRST_TOKEN_ID)


def learn_vocabulary(df: DataFrame, text: str, size: int = VOCAB, min_count: int = 1) -> DataFrame:
    """(token, id, n): the ``size`` most frequent tokens of a training part, ties by token; ids are dense, from
    FIRST_TOKEN_ID + 1 on.  FIRST_TOKEN_ID is the unknown token's.  At most ``size`` rows."""
    n = df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = n.where(F.col("n") >= min_count).orderBy(F.col("n").desc(), "token").limit(size)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "token"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("_at", "_t")).select(
        "_t.token", (F.col("_at") + FIRST_TOKEN_ID + 1).cast("bigint").alias("id"), (-F.col("_t.less")).alias("n"))


def encode_learned(df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_len: int) -> DataFrame:
    """(key, ids): ``encode`` with a learned vocabulary in place of hashed ids; tokens that it lacks, and words that
    merely look alike, never share an id with a known one.

    The vocabulary has a parameter's size and is broadcast; the at most ``max_len`` - 2 ids of a text that are kept
    come together in one exchange of numbers.
    """
    kept = df.select(key, F.posexplode_outer(F.slice(tokens(text), 1, max_len - 2)).alias("_at", "_token"))
    own = vocabulary.select(F.col("token").alias("_known"), F.col("id").alias("_id"))
    known = kept.join(F.broadcast(own), F.col("_token") == F.col("_known"), "left")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct(
        "_at", F.coalesce("_id", F.lit(FIRST_TOKEN_ID).cast("bigint")).alias("id"))))), lambda x: x["id"])
    return known.groupBy(key).agg(ids.alias("_ids")).select(key, framed(F.col("_ids"), F.size("_ids"), max_len).alias("ids"))


def framed(ids: Column, n: Column, max_len: int) -> Column:
    """[CLS] + ``n`` ids + [SEP], right-padded with PAD."""
    pad = F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.greatest(F.lit(max_len - 2) - n, F.lit(0)))
    return F.concat(F.array(F.lit(CLS_ID).cast("bigint")), ids, F.array(F.lit(SEP_ID).cast("bigint")), pad)


def encode(toks: Column, max_len: int, vocab: int = VOCAB) -> Column:
    """[CLS] + first max_len-2 token ids + [SEP], right-padded with PAD."""
    kept = F.slice(toks, 1, max_len - 2)
    return framed(token_ids(kept, vocab), F.size(kept), max_len)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x == PAD_ID, 0).otherwise(1))


def truncation_counts(toks: Column, max_len: int) -> list[Column]:
    """The reference's audit counts texts with token count + 2 >= max_len
    (exact fits included); the strict count is reported as well."""
    n = F.size(toks) + 2
    return [F.count(F.when(n >= max_len, 1)).cast("bigint").alias("n_ge"),
            F.count(F.when(n > max_len, 1)).cast("bigint").alias("n_gt")]


def weighted_ce(p: Column, y_idx: Column, w: Column, eps: float = 1e-12) -> Column:
    """Per-row weighted cross-entropy term -w_y * ln(p_y); average it over
    rows (divides by n, not by the sum of weights, like the reference)."""
    return -w * F.ln(F.greatest(F.element_at(p, y_idx + 1), F.lit(eps)))


def format_probs(p: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(p, lambda x: F.format_string(f"%.{digits}f", x)), ",")
