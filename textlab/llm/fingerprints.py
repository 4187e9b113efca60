"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is its terms (lower-case words), weighted by how often they
occur.  For each of ``samples`` independent draws every (term, draw) pair
has two gamma variates r, c and a uniform b, all hashed from the pair, so the
same in every document.  A term of weight w takes the quantised level
t = floor(ln w / r + b) and the value ln c - r (t + 1 - b); the draw's sample
is the (term, t) of the least value.  Two documents agree in a draw with a
probability of the generalised Jaccard similarity of their weights.

A text's terms are counted inside its row (hashes sorted, runs measured);
a hash aggregate then keeps the least packed value of each draw.

``compare`` fingerprints every document, its edited text (its later half
replaced by the beginning of the next document) and holds both against each
other and against the next document's.  Ids are cut into ranges at quantiles
and rows go once, with their texts, to their range; the first row of a range
also goes to the range before it.  All that follows, windows, counting and
aggregation, keeps that partitioning: texts are shuffled once, nothing else
is, and nothing is broadcast.

Defined results: NULL and empty texts have no terms and the empty
fingerprint; equal texts have equal fingerprints, whatever their rows; two
empty fingerprints are alike (1), an empty and another one are not (0).
NULL ids come first, equal ids by text; a single document is its own next;
an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import ship_package

#: Draws of a fingerprint.
SAMPLES = 32
_UNIT = 2.0**-21


def word_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of a text's words, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def run_starts(h: Column) -> Column:
    """Positions, from 1, at which a sorted array has a new value."""
    return F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (
        F.get(h, i - 1) != F.get(h, i - 2)))).otherwise(F.array().cast("array<int>"))


def runs(h: Column, starts: Column, which: int) -> Column:
    """array<struct<which, term, n>> of a sorted array and its run starts."""
    return F.transform(starts, lambda at, i: F.struct(
        F.lit(which).alias("which"), F.get(h, at - 1).alias("term"),
        (F.coalesce(F.get(starts, i + 1), F.size(h) + 1) - at).alias("n")))


def _uniform(h: str, shift: int) -> str:
    """21 bits of a hash as a number inside (0, 1)."""
    return f"(((shiftrightunsigned({h}, {shift}) & 2097151) + 0.5D) * {2.0**-21!r}D)"


def _sample(draw: int) -> Column:
    """The draw's value and sample of the weighted term (term, w: log weight) in 64 bits that sort by value.

    Values lie between -2**10 and 2**5: 42 bits of them, then 20 bits of the sample's hash.
    """
    h = f"xxhash64(term, {draw})"
    g = f"xxhash64({h})"
    r = f"(-ln({_uniform(h, 0)} * {_uniform(h, 21)}))"
    c = f"(-ln({_uniform(g, 0)} * {_uniform(g, 21)}))"
    b = _uniform(g, 42)
    t = f"floor(w / {r} + {b})"
    value = f"(ln({c}) - {r} * ({t} + 1 - {b}))"
    return F.expr(f"shiftleft(cast(({value} + 1024D) * 2147483648D as bigint), 20) | (xxhash64(term, {t}) & 1048575)")


def fingerprint(rows: DataFrame, keys: list[str], text_cols: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, one array<int> or NULL named as each text column) per distinct ``keys``.

    Rows of equal keys must hold equal texts.  If ``rows`` is already partitioned by some of the keys, nothing
    is shuffled; else one row per text and task is.
    """
    hashed = rows.select(*keys, *(word_hashes(F.col(c)).alias(f"h{k}") for k, c in enumerate(text_cols)))
    hashed = hashed.select("*", *(run_starts(F.col(f"h{k}")).alias(f"s{k}") for k in range(len(text_cols))))
    each = F.concat(*(runs(F.col(f"h{k}"), F.col(f"s{k}"), k) for k in range(len(text_cols))))
    each = hashed.select(*keys, F.inline_outer(each)).select(*keys, "which", "term", F.log("n").alias("w"))
    least = each.groupBy(*keys, "which").agg(*(F.min(_sample(draw)).alias(f"m{draw}") for draw in range(samples)))
    own = F.when(F.col("m0").isNotNull(), F.array(*(
        F.col(f"m{draw}").bitwiseAND(F.lit(2**20 - 1)).cast("int") for draw in range(samples))))
    return least.select(*keys, "which", own.alias("print")).groupBy(*keys).agg(*(
        F.first(F.when(F.col("which") == k, F.col("print")), ignorenulls=True).alias(c)
        for k, c in enumerate(text_cols)))


def as_text(fingerprint: Column) -> Column:
    """Five hexadecimal digits for each draw; the empty text for none."""
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 5, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of draws in which two fingerprints (NULL: no terms) agree."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal)


def _range(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value`` (0 for NULL), by binary search."""
    if not cuts:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")  # one constant
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(array, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def followed(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, place, copy, doc_id, text, next_text), partitioned by range.

    ``next_text`` is the text of the next document; rows with ``copy`` are the next range's first rows.
    """
    ship_package(docs.sparkSession)
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ranges - 1 ids, each of a row
    known = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges),
                     F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    cuts = sorted({*(known[0] or [])} - {known[1]})
    home = _range(cuts, F.col("doc_id"))
    first = F.col("doc_id").isNull() if known[2] else F.col("doc_id") == F.lit(known[1]).cast("long")
    starts = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    none = F.array().cast("array<struct<range: int, copy: boolean>>")

    def place(at: Column, copy: bool) -> Column:
        return F.array(F.struct(at.cast("int").alias("range"), F.lit(copy).alias("copy")))

    rows = rows.withColumn("home", home)
    begins = F.coalesce(F.get(starts, F.col("home") - 1) == F.col("doc_id"), F.lit(False)) & (F.col("home") > 0)
    places = F.concat(place(F.col("home"), False),
                      F.when(begins, place(F.col("home") - 1, True)).otherwise(none),
                      F.when(F.coalesce(first, F.lit(False)), place(F.lit(len(cuts)), True)).otherwise(none))
    rows = rows.select("doc_id", "text", F.inline(places))
    inside = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("range", F.row_number().over(inside).alias("place"), "copy", "doc_id", "text",
                       F.coalesce(F.lead("text").over(inside), F.lit("")).alias("next_text"))


def compare(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = followed(docs, id_col=id_col, text_col=text_col)
    rows = rows.select("range", "place", "copy", "doc_id", F.length("text").cast("long").alias("n_chars"), "text",
                       edited.alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    prints = fingerprint(rows, ["range", "place", "copy", "doc_id", "n_chars", "sha"], ["text", "edited"], samples)
    inside = Window.partitionBy("range").orderBy("place")
    out = prints.withColumn("next", F.lead("text").over(inside)).filter(~F.col("copy"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                      as_text(F.col("text")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
                      likeness(F.col("text"), F.col("edited")).alias("near_edited"),
                      likeness(F.col("text"), F.col("next")).alias("near_next"))
