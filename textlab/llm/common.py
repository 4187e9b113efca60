"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.session import ship_package

#: What operators keep in a Python worker from one task to the next.
CACHES: list[dict] = []


def forget() -> None:
    """Drop what the operators of earlier stages have left in this Python worker, which Spark uses again for later ones."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text, *more): only the columns an operator reads, NULL text as the empty text.

    Other columns of ``docs``, whatever their names, never reach the operator.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of Python lists, ``size`` rows at a time: the
    texts held as Python objects stay bounded whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield {n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)}


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[dict], dict | None]) -> DataFrame:
    """``df`` with what ``fn`` returns for each row (a dict of the named columns) put in place of those
    columns; rows for which it returns None go.  All other columns stay as they are."""
    ship_package(df.sparkSession)
    at = {c: df.columns.index(c) for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                new = [fn(dict(zip(columns, row)))
                       for row in zip(*(part.column(at[c]).to_pylist() for c in columns))]
                part = part.filter(pa.array([x is not None for x in new], pa.bool_()))
                own = list(part.columns)
                for c, i in at.items():
                    own[i] = pa.array([x[c] for x in new if x is not None], own[i].type)
                yield pa.RecordBatch.from_arrays(own, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def filter_rows(df: DataFrame, columns: list[str], fn: Callable[[dict], bool]) -> DataFrame:
    """The rows of ``df``, unchanged, for which ``fn`` of the named columns holds."""
    return map_rows(df, columns, lambda row: row if fn(row) else None)
