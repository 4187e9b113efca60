"""Answers that survive a restart: a ledger of requests, keyed by the prompt's digest.

Every call's outcome is a row of a stored table (digest, attempt, answer,
error, valid).  Work is done in waves, slices of the digests; a wave asks the
prompts that the ledger has no valid answer to and that have attempts left,
and appends what came back.  What a wave has committed is never asked again:
not by the next attempt, not by a rerun after a crash, not for a second row
with the same prompt.  An executor that is lost repeats the calls of the
tasks it held in the running wave; ``WAVE`` bounds a wave.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import normalise_answer
from textlab.operators.zeroshot import _call, _is_null, _parts, label_to_id
from textlab.session import ship_package

LEDGER = "digest string, attempt int, answer string, error string, valid boolean"
#: Prompts of a wave.
WAVE = 1_000_000


def digest(prompt: str):
    return F.sha2(F.col(prompt), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The outcomes so far; no rows for a ledger that was not begun."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _ask(todo: DataFrame, answer_fn: Callable[[pd.Series, int], "pd.Series | list"], labels: list[str]) -> DataFrame:
    known = set(labels)

    def run(batches):
        for pdf in _parts(batches):
            out = {"digest": [], "attempt": [], "answer": [], "error": [], "valid": []}
            for attempt, part in pdf.groupby("attempt"):
                now = int(attempt)
                got, failed = _call(lambda v: answer_fn(v, now), part["prompt"])
                for d, a, e in zip(part["digest"], got, failed):
                    a = None if _is_null(a) else str(a)
                    good = a is not None and a.replace("'", "") in known
                    for c, v in zip(out, (d, now, a, None if good else e or "unknown label", good)):
                        out[c].append(v)
            yield pd.DataFrame(out).astype({"attempt": "int32"})

    ship_package(todo.sparkSession)
    return todo.mapInPandas(run, LEDGER)


def settle(df: DataFrame, prompt: str, answer_fn: Callable[[pd.Series, int], "pd.Series | list"], labels: list[str],
           ledger: str, max_attempts: int = 3, wave: int = WAVE) -> None:
    """Bring the ledger to where every distinct prompt of ``df`` has a valid answer or ``max_attempts`` attempts.

    ``answer_fn(prompts, attempt)`` gets whole prompts; a call that fails is made again row by row, so that a bad
    prompt does not cost its neighbours their answers.  NULL prompts are not asked.
    """
    spark = df.sparkSession
    asked = df.where(F.col(prompt).isNotNull()).select(digest(prompt).alias("digest"), F.col(prompt).alias("prompt"))
    waves = max(1, -(-asked.count() // wave))
    for k in range(waves):
        own = F.pmod(F.xxhash64("digest"), F.lit(waves)) == k
        for _ in range(max_attempts):
            state = read_ledger(spark, ledger).where(own).groupBy("digest").agg(
                F.max("valid").alias("_done"), F.max("attempt").alias("_tries"))
            over = state.where(F.col("_done") | (F.col("_tries") >= max_attempts)).select("digest")
            todo = asked.where(own).join(over, "digest", "left_anti").groupBy("digest").agg(F.any_value("prompt").alias("prompt"))
            todo = todo.join(state.select("digest", "_tries"), "digest", "left").select(
                "digest", "prompt", (F.coalesce("_tries", F.lit(0)) + 1).alias("attempt"))
            if todo.isEmpty():
                break
            _ask(todo, answer_fn, labels).write.mode("append").parquet(ledger)


def outcomes(df: DataFrame, prompt: str, labels: list[str], ledger: str) -> DataFrame:
    """``df`` with answer, y_pred, attempts and error from the ledger: the valid answer of a prompt, or its last
    attempt; NULL for prompts that were never asked."""
    best = read_ledger(df.sparkSession, ledger).groupBy("digest").agg(
        F.max_by(F.struct("answer", "error", "valid"), F.struct("valid", "attempt")).alias("o"), F.max("attempt").alias("attempts"))
    best = best.select(F.col("digest").alias("_digest"), "o.answer", "o.error", "attempts",
                       F.when(F.col("o.valid"), label_to_id(normalise_answer("o.answer"), labels)).alias("y_pred"))
    return df.join(best, digest(prompt) == F.col("_digest"), "left").select(*df.columns, "answer", "y_pred", "attempts", "error")
