"""Token ids as binary files: patched frame-of-reference blocks.

``write`` encodes every text, closes it with ``END_ID`` and writes all ids in
ascending doc_id order; ``read`` reads the files back.

A file is a run of *chunks*, each followed by a newline.  A chunk holds whole
documents of about ``CHUNK`` ids and stands alone: header, documents (id,
whether it is NULL, count of ids), start of each block, blocks.  A block is
``BLOCK`` ids less their minimum, in as many bits as ``PERCENTILE`` percent
of them need; what an outlier has above that width is patched in from the
block's exception list.  Block starts are indexed, so ``ids_at`` decodes the
blocks of a slice alone.  All numbers are little-endian.

    header     magic, documents (u32), ids (u64), blocks (u32), bytes of the chunk after the header (u32)
    documents  ids (i64 each), is NULL (u8 each, padded to 8), counts (i64 each)
    index      first 32-bit word of each block, counted from the first block (u32 each), and the end
    block      minimum (u32); width, exceptions, ids (6, 11, 11 bits); words; exceptions (place 10, high part 22 bits)

Texts are shuffled once, by ranges of doc_id; each range is a task, which
streams: memory is one chunk, a longer document is a chunk of its own.
Files are written by Spark's own committed writer (chunks as raw lines), to
any store that Spark knows, so a lost or repeated task leaves no half file;
``FILE_CHUNKS`` bounds a file.  Only a row a file is needed to number ids
over all files.

Defined results: a NULL or empty text is the closing id alone; NULL doc_ids
come first and are read back as NULL; rows of one doc_id are ordered by
their text's hash, repeated rows are all kept; an empty table gives no
documents.  A text is encoded whole, however long.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import rows_of, texts
from textlab.llm.tokens import LibraryBackend, default_path, encoder
from textlab.session import scratch_dir, ship_package

MAGIC = b"PFR1"
_HEADER = struct.Struct("<4sIQII")
END_ID = 2
BLOCK = 1024
#: Share of a block's ids that its width must hold.
PERCENTILE = 98
#: Ids of a chunk, and chunks of a file.
CHUNK, FILE_CHUNKS = 1 << 20, 16
#: Bits of an exception that hold its place, and its high part.
_PLACE, _HIGH = 10, 22


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each number of up to 32 bits needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """blocks x BLOCK numbers of ``width`` bits as blocks x (32 * width) words; 32 numbers of a lane share words."""
    lanes = values.reshape(len(values), 32, BLOCK // 32)
    out = np.zeros((len(values), width, BLOCK // 32), np.uint32)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        out[:, word] |= lanes[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, k] >> np.uint32(32 - shift)
    return out.reshape(len(values), width * BLOCK // 32)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), width, BLOCK // 32)
    out = np.empty((len(words), 32, BLOCK // 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        x = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | lanes[:, word + 1] << np.uint32(32 - shift)
        out[:, k] = x & mask
    return out.reshape(len(words), BLOCK)


def blocks_of(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids of up to 32 bits."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    padded = np.full(n * BLOCK, ids[-1], np.uint32)
    padded[:len(ids)] = ids
    padded = padded.reshape(n, BLOCK)
    least = padded.min(1)
    rest = padded - least[:, None]
    bits = _bits(rest)
    kept = np.partition(bits, min(BLOCK - 1, int(BLOCK * percentile / 100)), axis=1)[:, min(BLOCK - 1, int(BLOCK * percentile / 100))]
    width = np.maximum(kept, bits.max(1) - _HIGH)  # an exception's high part has to fit
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = rest[own]
        packed = _pack(part & np.uint32((1 << int(w)) - 1), int(w)) if w else np.empty((len(own), 0), np.uint32)
        block, place = np.nonzero(bits[own] > w)
        above = (place << _HIGH | part[block, place] >> np.uint32(w)).astype("<u4") if len(block) else np.empty(0, "<u4")
        ends = np.searchsorted(block, np.arange(len(own) + 1))
        for k, at in enumerate(own):
            size = min(BLOCK, len(ids) - int(at) * BLOCK)
            odd = above[ends[k]:ends[k + 1]]
            head = struct.pack("<II", int(least[at]), int(w) | len(odd) << 6 | size << 17)
            out[at] = head + packed[k].astype("<u4").tobytes() + odd.tobytes()
    return out


def decoded(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that start at the given words."""
    if not len(starts):
        return np.empty(0, np.uint32)
    least, what = words[starts], words[starts + 1]
    width, odd, size = what & 63, what >> 6 & 2047, what >> 17
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        at = starts[own]
        n = int(w) * BLOCK // 32
        part = _unpack(words[at[:, None] + 2 + np.arange(n)], int(w)) if w else np.zeros((len(own), BLOCK), np.uint32)
        many = odd[own].astype(np.int64)
        if many.any():
            block = np.repeat(np.arange(len(own)), many)
            k = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
            patch = words[at[block] + 2 + n + k]
            part[block, patch >> _HIGH] |= (patch & ((1 << _HIGH) - 1)) << np.uint32(w)
        out[own] = part + least[own, None]
    return out[np.arange(BLOCK) < size[:, None]]


def chunk_of(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A chunk of documents, whose ids are given as little-endian 32-bit numbers."""
    blocks = blocks_of(np.frombuffer(b"".join(ids), "<u4"))
    starts = np.cumsum([0, *(len(b) // 4 for b in blocks)]).astype("<u4")
    nulls = np.zeros(-(-len(ids) // 8) * 8, np.uint8)
    nulls[:len(ids)] = [d is None for d in doc_ids]
    body = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(),
                     np.array([len(x) // 4 for x in ids], "<i8").tobytes(), starts.tobytes(), *blocks])
    return _HEADER.pack(MAGIC, len(ids), sum(len(x) for x in ids) // 4, len(blocks), len(body)) + body


class Chunk:
    """A chunk that is read back; ids are decoded when asked for."""

    def __init__(self, raw: memoryview):
        magic, docs, self.n_ids, blocks, size = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a chunk of token ids")
        at = _HEADER.size
        self.end = at + size
        if len(raw) < self.end:
            raise ValueError("a chunk is cut short")
        ids = np.frombuffer(raw, "<i8", docs, at)
        nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        at += 8 * docs + -(-docs // 8) * 8
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.counts = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(raw, "<u4", blocks + 1, at).astype(np.int64)
        at += 4 * (blocks + 1)
        self.words = np.frombuffer(raw, "<u4", (self.end - at) // 4, at)

    def ids_at(self, start: int, stop: int) -> np.ndarray:
        """Ids of a slice; only its blocks are decoded."""
        first = start // BLOCK
        return decoded(self.words, self.starts[first:min(-(-stop // BLOCK), len(self.starts) - 1)])[
            start - first * BLOCK:stop - first * BLOCK]


def chunks_in(raw: bytes) -> Iterator[Chunk]:
    view, at = memoryview(raw), 0
    while at < len(view):
        chunk = Chunk(view[at:])
        yield chunk
        at += chunk.end + 1  # and the newline


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, ranges: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` into files under the new folder ``out``; ``ranges``: parts of the doc_ids, by default
    as many as the session's shuffles have."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(LibraryBackend, path)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list = []
        held: list[bytes] = []
        size = 0
        for rows in rows_of(batches, 64):
            for doc, ids in zip(rows["doc_id"], enc.encode(rows["text"]), strict=True):
                n = len(ids) // 4 + 1
                if held and size + n > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk_of(doc_ids, held)], pa.binary())], names=["chunk"])
                    doc_ids, held, size = [], [], 0
                doc_ids.append(doc)
                held.append(ids + end)
                size += n
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([chunk_of(doc_ids, held)], pa.binary())], names=["chunk"])

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = texts(docs, id_col, text_col)
    rows = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    chunks = rows.sortWithinPartitions(*keys).mapInArrow(run, "chunk binary")
    # raw bytes pass through the text writer as they are
    (chunks.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("compression", "none").option("maxRecordsPerFile", FILE_CHUNKS).text(out))


def _files(spark: SparkSession, out: str) -> DataFrame:
    """(part, roll, content): files in order of (part, roll), the writer's task and its file."""
    ship_package(spark)
    part, roll = (F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("long") for k in (1, 2))
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).filter("length > 0")
            .select(part.alias("part"), roll.alias("roll"), "content"))


def _documents(spark: SparkSession, out: str, with_ids: bool) -> DataFrame:
    """(part, roll, before, doc_id, n_tokens, ids_crc32[, ids]); ``before``: ids before the document in its file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                before, part, roll = 0, b.column(0)[k].as_py(), b.column(1)[k].as_py()
                for chunk in chunks_in(b.column(2)[k].as_buffer()):
                    raw = chunk.ids_at(0, chunk.n_ids).astype("<u4").tobytes()
                    ends = np.cumsum(chunk.counts)
                    each = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), chunk.counts.tolist())]
                    n = len(each)
                    cols = [pa.array([part] * n, pa.int64()), pa.array([roll] * n, pa.int64()),
                            pa.array(before + ends - chunk.counts), pa.array(chunk.doc_ids, pa.int64()),
                            pa.array(chunk.counts, pa.int64()), pa.array(list(map(zlib.crc32, each)), pa.int64())]
                    names = ["part", "roll", "before", "doc_id", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array(each, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    before += chunk.n_ids

    kind = "part long, roll long, before long, doc_id long, n_tokens long, ids_crc32 long"
    return _files(spark, out).mapInArrow(run, kind + ", ids binary" if with_ids else kind)


def _started(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with ``start`` over all files; ``files``: (part, roll, n), a row a file."""
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("part", "roll", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return found.join(first, ["part", "roll"]).withColumn("start", F.col("first") + F.col("before"))


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit numbers.

    ``start`` is the number of ids of all documents before it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(c.n_ids for c in chunks_in(x.as_buffer())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["part", "roll", "n"])

    files = _files(spark, out).mapInArrow(count, "part long, roll long, n long")
    return _started(_documents(spark, out, True), files).select("doc_id", "start", "n_tokens", "ids")


def read_digest(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document; the files are decoded once."""
    where = scratch_dir(spark, "token-digest")
    _documents(spark, out, False).write.parquet(where)
    found = spark.read.parquet(where)
    files = found.groupBy("part", "roll").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    return _started(found, files).select("doc_id", "start", "n_tokens", "ids_crc32")
