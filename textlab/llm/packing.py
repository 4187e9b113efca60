"""Packing by power-of-two decomposition.

A document's token count is a sum of powers of two.  The document is cut at
those lengths, longest first, into pieces of at most ``max_len`` tokens, and
every piece is a sequence of its own: all sequences of a length form one
bucket, no sequence crosses documents and none needs padding.  Bucketing is
a property of the row (``length``), so nothing is shuffled; ``write_buckets``
lays the buckets out as partitions of a table.

Defined results: a NULL or empty text is the closing token alone; repeated
rows are packed again, each into sequences of its own; an empty table gives
no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import rows_of, texts
from textlab.llm.tokens import LibraryBackend, default_path, encoder

MAX_LEN = 4096
#: Closes each document.
END_ID = 2


def pieces_of(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the binary pieces of ``n`` tokens; ``max_len`` is a power of two."""
    out, at = [(k, max_len) for k in range(0, n - max_len + 1, max_len)], n - n % max_len
    for bit in range(max_len.bit_length() - 2, -1, -1):
        if n >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` is binary, little-endian unsigned 32-bit.  ``sequence_id`` is
    unique within one result; a piece fills its sequence, so ``offset`` is 0.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(LibraryBackend, path)
        end = np.array([end_id], "<u4").tobytes()
        for rows in rows_of(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(rows["doc_id"], enc.encode(rows["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in pieces_of(n, max_len):
                    for c, v in zip(cols, (doc, start, length, ids[4 * start:4 * (start + length)], n)):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "start", "length", "ids", "doc_tokens"])

    out = texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """A Parquet table with one partition per piece length."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)
