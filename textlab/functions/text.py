"""String column functions (JVM-side, no UDFs).

Python's ``re`` is Unicode-aware; Java regexes are not by default.  The
character classes below reproduce Python's ``\\w`` and ``\\s`` in Java
syntax so that every expression stays a built-in ``regexp_replace``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: regex classes and patterns (must match Python semantics) ---
# Python \s  == Unicode White_Space plus the four information separators.
WS = r"[\x1c-\x1f\p{IsWhite_Space}]"
# Python \w  == Unicode letters and numbers plus underscore.
WORD = r"[\p{L}\p{N}_]"
# Twitter handle: "@" followed by 2..15 word characters.
HANDLE = "@" + WORD + "{2,15}"
# URL pattern of the tweet cleaner (http/https, optional www, host, TLD, path).
URL = (r"(?U)https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
       r"(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)")
# Token rule used by the lexicon scorer, the features and the NB model.
TOKEN_SPLIT = r"[^\p{L}]+"
# Values the labelled-line reader turns into NULL (pandas default NA strings).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def collapse_ws(col) -> Column:
    """``re.sub(r"\\s\\s+", " ", x)``: runs of 2+ whitespace become one space."""
    return F.regexp_replace(_c(col), f"{WS}{WS}+", " ")


def remove_handles(col) -> Column:
    """Remove ``@handle`` repeatedly until none is left (fixpoint).

    Every effective pass removes at least one ``@``, so the number of ``@``
    in the text bounds the passes.  The fold carries a ``done`` flag: once a
    pass finds no handle, the remaining steps are O(1), so the cost is
    (passes actually needed + 1) scans of the text, not one per ``@``.
    """
    c = _c(col)
    n_at = F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit("")))

    def step(acc, _):
        t = acc["t"]
        return F.when(acc["done"], acc).otherwise(
            F.when(t.rlike(HANDLE), F.struct(F.regexp_replace(t, HANDLE, "").alias("t"), F.lit(False).alias("done")))
            .otherwise(F.struct(t.alias("t"), F.lit(True).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n_at)),
                       F.struct(c.alias("t"), F.lit(False).alias("done")), step, lambda acc: acc["t"])


def clean_tweet(col) -> Column:
    """The tweet cleaner, steps in the reference order."""
    x = F.replace(_c(col), F.lit("RT "), F.lit(""))
    x = F.regexp_replace(x, URL, "")
    x = remove_handles(x)
    x = collapse_ws(x)
    x = F.regexp_replace(x, f"^{WS}", "")
    return F.replace(x, F.lit('"'), F.lit(""))


def normalise_ws(col) -> Column:
    """Remove ``---`` then collapse whitespace runs (order matters)."""
    return collapse_ws(F.replace(_c(col), F.lit("---"), F.lit("")))


def concat_context(before, content, after) -> Column:
    """before + ' ' + content + after; non-strings count as ''.

    The missing space before ``after`` is the reference behaviour.
    """
    return F.concat(F.coalesce(_c(before), F.lit("")), F.lit(" "),
                    F.coalesce(_c(content), F.lit("")), F.coalesce(_c(after), F.lit("")))


def tokens(col) -> Column:
    """Lower-cased letter runs; empty strings dropped."""
    return F.filter(F.split(F.lower(_c(col)), TOKEN_SPLIT), lambda t: t != "")


def with_runs(df: DataFrame, values: Column, out: str) -> DataFrame:
    """Adds ``out``: array of (value, n), each distinct value of an array with its count, in order of value.

    Equal values stand together once the array is sorted, so counting needs no rows and no exchange.
    """
    x = df.withColumn("_sorted", F.sort_array(values))
    size = F.coalesce(F.size("_sorted"), F.lit(0))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("_starts", F.filter(places, lambda k: (k == 0) | (F.get("_sorted", k) != F.get("_sorted", k - 1))))
    run = F.transform("_starts", lambda at, k: F.struct(F.get("_sorted", at).alias("value"),
                                                        (F.coalesce(F.get("_starts", k + 1), size) - at).alias("n")))
    return x.withColumn(out, run).drop("_sorted", "_starts")


def with_token_runs(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of (token, n) of a text, counted inside its row; NULL and empty texts have none."""
    runs = with_runs(df, tokens(text), out)
    return runs.withColumn(out, F.transform(out, lambda r: F.struct(r["value"].alias("token"), r["n"].alias("n"))))


def labelled_line(col) -> Column:
    """Labelled-reader cell: stripped line, NA tokens become NULL."""
    s = py_strip(col)
    return F.when(s.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(s)


def render_prompt(template: str, text, labels: list[str]) -> Column:
    """template + text + blank line + Labels: 'a', 'b' + blank line + Answer: """
    label_part = ", ".join(f"'{lab}'" for lab in labels)
    return F.concat(F.lit(template), _c(text),
                    F.lit(f"\n\nLabels: {label_part}\n\nAnswer: "))


def normalise_answer(col) -> Column:
    """Delete apostrophes only; no trim and no case folding."""
    return F.replace(_c(col), F.lit("'"), F.lit(""))
