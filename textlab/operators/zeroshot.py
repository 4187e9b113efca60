"""Zero-shot scoring: lexicon scorer, generative answer loop, text mapping.

The built-in scorer is a lexicon: for every label, the number of text
tokens in its word list.  The lexicon is a small parameter, so it is
folded into column expressions (a projection, no join and no shuffle).
User scorers / answer functions run through ``mapInPandas`` (Arrow
batches), the contract being vectorised pandas in, pandas out.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.arrays import argmax
from textlab.functions.text import TOKEN_SPLIT, normalise_answer, render_prompt
from textlab.session import ship_package

# --- fixed values: default language lexicon (label order is the class id) ---
LEXICON_LABELS = ["en", "de", "fr", "es"]
LEXICON = {
    "en": ["the", "and", "of", "with"],
    "de": ["der", "die", "und", "ist"],
    "fr": ["le", "de", "la", "et"],
    "es": ["el", "que", "los", "y"],
}
PROMPT_TEMPLATE = "Classify the language of the following text.\n\nText: "


def lexicon_tokens(text, lexicon=LEXICON) -> Column:
    """The text's tokens that are in any word list: one split of the whole
    text, one hash-set membership test per token."""
    words = sorted({w for ws in lexicon.values() for w in ws})
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), TOKEN_SPLIT),
                    lambda t: t.isin(words))


def hits_from_tokens(lex_tokens: Column, labels=LEXICON_LABELS, lexicon=LEXICON) -> Column:
    """ARRAY<BIGINT> of hits per label (label order) over pre-filtered tokens."""
    def member_of(words):
        return lambda t: t.isin(words)

    return F.array(*[F.size(F.filter(lex_tokens, member_of(lexicon.get(lab, [])))).cast("bigint")
                     for lab in labels])


def with_lexicon_hits(df: DataFrame, text: str = "text", labels=LEXICON_LABELS, lexicon=LEXICON,
                      out: str = "hits") -> DataFrame:
    """Adds ``out``; the token scan happens once per row (own projection)."""
    return df.withColumn("_lt", lexicon_tokens(text, lexicon)) \
             .withColumn(out, hits_from_tokens(F.col("_lt"), labels, lexicon)).drop("_lt")


def lexicon_predict(df: DataFrame, text: str = "text", labels=LEXICON_LABELS, lexicon=LEXICON,
                    out: str = "y_pred") -> DataFrame:
    """Label with most hits; ties and no hits -> first label in order."""
    lab = F.array(*[F.lit(x) for x in labels])
    return with_lexicon_hits(df, text, labels, lexicon, "_hits").withColumn(
        out, F.element_at(lab, argmax(F.col("_hits")) + 1)).drop("_hits")


#: Rows that a user function gets at once; the session's batch size is left alone.
CALL_ROWS = 1000


def _parts(batches, rows: int = CALL_ROWS):
    """Arrow batches in slices of at most ``rows`` rows, each with a fresh 0..n-1 index."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows].reset_index(drop=True)


def _call(fn, values: pd.Series) -> tuple[list, list]:
    """(results, errors) by position.  A failing call, or one of another length, is made again row by row,
    so that a bad row never touches its neighbours and results do not depend on how rows are batched."""
    try:
        got = list(fn(values))
        if len(got) != len(values):
            raise ValueError(f"{len(got)} results for {len(values)} rows")
        return got, [None] * len(got)
    except Exception as exc:
        if len(values) == 1:
            return [None], [repr(exc)]
        pairs = [_call(fn, values.iloc[[k]]) for k in range(len(values))]
        return [g[0] for g, _ in pairs], [e[0] for _, e in pairs]


def _is_null(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


#: Characters of the texts that a scorer gets at once, unless a single text is longer.
CALL_CHARS = 1_000_000
_LOADED: dict = {}


def _loaded(load: Callable, name: str):
    """What ``load`` makes of a shipped file, made once in each worker."""
    if name not in _LOADED:
        from pyspark import SparkFiles
        _LOADED[name] = load(SparkFiles.get(name))
    return _LOADED[name]


def _by_chars(pdf: pd.DataFrame, text: str, most: int):
    """A frame in slices whose texts have about ``most`` characters."""
    start, n = 0, 0
    for k, t in enumerate(pdf[text]):
        size = len(t) if isinstance(t, str) else 0
        if k > start and n + size > most:
            yield pdf.iloc[start:k].reset_index(drop=True)
            start, n = k, 0
        n += size
    yield pdf.iloc[start:].reset_index(drop=True)


def scorer_predict(df: DataFrame, text: str, labels: list[str], scorer: Callable, out: str = "y_pred",
                   model: str | None = None, max_chars: int = CALL_CHARS) -> DataFrame:
    """Pluggable zero-shot scorer: ``scorer(texts, labels)`` returns one score
    per (text, label) (a frame or list of rows in label order); the best label
    wins, ties -> first label.  Adds ``scores``, ``error``, ``out``.

    With ``model``, a file in any store, the file is shipped to every worker and ``scorer`` is its loader:
    ``scorer(local path)`` returns the scoring function and runs once per worker.  Texts come in slices of at most
    ``CALL_ROWS`` rows and about ``max_chars`` characters.  A call that fails, or whose result does not fit its
    texts, is made again row by row: a failing row has NULL scores, a NULL label and an error, and its neighbours
    are as without it, however rows are batched.  Files of one name must have one content.
    """
    ship_package(df.sparkSession)
    schema = T.StructType(list(df.schema.fields) + [T.StructField("scores", T.ArrayType(T.DoubleType())),
                                                    T.StructField("error", T.StringType())])
    name = None
    if model is not None:
        df.sparkSession.sparkContext.addFile(model)
        name = model.rstrip("/").rsplit("/", 1)[-1]

    def run(batches):
        own = scorer if name is None else _loaded(scorer, name)

        def rows_of(texts: pd.Series) -> list:
            got = own(texts, labels)
            rows = [[float(x) for x in r] for r in (got.values.tolist() if hasattr(got, "values") else got)]
            if any(len(r) != len(labels) or any(x != x for x in r) for r in rows):
                raise ValueError(f"a score for each of {len(labels)} labels is needed")
            return rows

        for pdf in _parts(batches):
            for part in _by_chars(pdf, text, max_chars):
                scores, errors = _call(rows_of, part[text]) if len(part) else ([], [])
                yield part.assign(scores=pd.Series(scores, dtype=object), error=pd.Series(errors, dtype=object))

    lab = F.array(*[F.lit(x) for x in labels])
    best = F.when(F.col("scores").isNotNull(), F.element_at(lab, argmax(F.col("scores")) + 1))
    return df.mapInPandas(run, schema).withColumn(out, best)


def label_to_id(col, labels: list[str]) -> Column:
    """Position of the label in the list (the class id); unknown -> NULL."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), col)
    return F.when(pos > 0, (pos - 1).cast("int"))


def answer_loop(df: DataFrame, prompt_col: str, answer_fn: Callable[[pd.Series, int], "pd.Series | list"],
                labels: list[str], max_attempts: int | None = 3) -> DataFrame:
    """Call ``answer_fn`` until the cleaned answer is a known label.

    ``max_attempts=None`` never gives up; with a bound, a row without a valid
    answer keeps ``y_pred`` NULL with the last error (count and rerun such
    rows with ``unresolved`` and ``answer_again``).  Only the calls run in
    Python; cleaning and the label lookup are column expressions.
    Adds: answer STRING, y_pred INT, attempts INT, error STRING.
    """
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField("answer", T.StringType()), T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType())])
    known = set(labels)

    def run(batches):
        for pdf in _parts(batches):
            n = len(pdf)
            answer, attempts, error = [None] * n, [0] * n, [None] * n
            todo, attempt = list(range(n)), 0
            while todo and (max_attempts is None or attempt < max_attempts):
                attempt += 1
                now = attempt  # the function sees the number of this attempt
                got, failed = _call(lambda v: answer_fn(v, now), pdf[prompt_col].iloc[todo])
                left = []
                for k, a, e in zip(todo, got, failed):
                    a = None if _is_null(a) else str(a)
                    answer[k], attempts[k], error[k] = a, attempt, e
                    if a is None or a.replace("'", "") not in known:
                        error[k] = e or "unknown label"
                        left.append(k)
                todo = left
            yield pdf.assign(answer=pd.Series(answer, dtype=object), attempts=pd.Series(attempts, dtype="int32"),
                             error=pd.Series(error, dtype=object))

    out = df.mapInPandas(run, schema)
    return out.withColumn("y_pred", label_to_id(normalise_answer("answer"), labels)).select(
        *df.columns, "answer", "y_pred", "attempts", "error")


def unresolved(answered: DataFrame) -> DataFrame:
    """Rows of an ``answer_loop`` that have no valid answer yet."""
    return answered.where(F.col("y_pred").isNull())


def answer_again(answered: DataFrame, prompt_col: str, answer_fn, labels: list[str],
                 max_attempts: int | None = 3) -> DataFrame:
    """An ``answer_loop`` over its unresolved rows alone; ``answered`` is best a stored table."""
    added = ["answer", "y_pred", "attempts", "error"]
    again = answer_loop(unresolved(answered).drop(*added), prompt_col, answer_fn, labels, max_attempts)
    return answered.where(F.col("y_pred").isNotNull()).unionByName(again)


def map_text(df: DataFrame, text_col: str, fn: Callable[[pd.Series], "pd.Series | list"],
             select: Column | None = None, fallback: str = "", out: str = "text_out") -> DataFrame:
    """Row-wise text mapping (e.g. translation) through a user function.

    Rows where ``select`` is false pass through unchanged (the reference
    reused the previous row's result there); a row whose call fails, or
    yields NULL, takes ``fallback``.  Results are taken by position.
    """
    sel = select if select is not None else F.lit(True)
    staged = df.withColumn("_sel", F.coalesce(sel, F.lit(False)))
    schema = T.StructType(list(staged.schema.fields) + [T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in _parts(batches):
            res = [None if _is_null(x) else x for x in pdf[text_col]]
            chosen = [k for k, s in enumerate(pdf["_sel"]) if s]
            if chosen:
                got, _ = _call(fn, pdf[text_col].iloc[chosen])
                for k, g in zip(chosen, got):
                    res[k] = fallback if _is_null(g) else g
            yield pdf.assign(**{out: pd.Series(res, dtype=object)})

    return staged.mapInPandas(run, schema).drop("_sel")


def prompt_column(text: str, labels: list[str] = LEXICON_LABELS, template: str = PROMPT_TEMPLATE) -> Column:
    return render_prompt(template, text, labels)


__all__ = ["LEXICON", "LEXICON_LABELS", "PROMPT_TEMPLATE", "lexicon_tokens", "hits_from_tokens", "with_lexicon_hits",
           "lexicon_predict", "scorer_predict", "label_to_id", "answer_loop", "unresolved", "answer_again", "map_text",
           "prompt_column", "normalise_answer"]
