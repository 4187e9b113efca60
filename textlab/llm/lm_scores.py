"""LM scoring: cross-entropy difference of a target and a background model.

Both models are interpolated bigram models over the ids of one public
vocabulary.  The background counts come from all documents, the target
counts from those that a label marks as wanted.  A document's own counts are
taken out of both before it is scored, so that having taught a model is no
advantage.  The score is the background's loss per token less the target's:
the higher, the more a document resembles the target.

Bigrams are counted exactly.  Ids are made once and written to the shared
folder, in blocks of about ``BLOCK`` tokens.  Each block gives a row for each of its
distinct bigrams; these are summed by bigram over all blocks, and every
block gets the sums of its own bigrams back and scores its documents.  What
is shuffled grows with the input; a bigram has a row a block at most, so no
common one is a hot key.  Only the counts by id, as many as the vocabulary
has ids, are collected and broadcast.

Defined results: a NULL or empty text has no tokens, NULL losses and score
0; conflicting or NULL labels are no target; without any target document the
target model is uniform; repeated rows are counted and scored as they are;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import rows_of, texts
from textlab.llm.tokens import LibraryBackend, default_path, encoder
from textlab.session import scratch_dir

#: Tokens (and documents) of a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Weight of the bigram estimate.
MIX = 0.7


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Each token but the first with the token before it, as one number."""
    return (ids[:-1] << 32) | ids[1:]


def own_counts(keys: np.ndarray) -> np.ndarray:
    """How often each of ``keys`` stands among them."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


@dataclass
class Counts:
    """Counts of a corpus by id, and in all."""

    ids: np.ndarray
    total: int

    def loss(self, ids: np.ndarray, pairs: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None) -> float:
        """Bits per token; ``pairs``: the corpus's counts of the text's bigrams; ``own``: the text's own
        counts, by token and by bigram, that are taken out first."""
        single, total = self.ids[ids], self.total
        if own is not None:
            single, pairs, total = single - own[0], pairs - own[1], total - len(ids)
        # of each token's predecessor; the first token has none: its bigram estimate is the unigram's
        before = self.ids[ids[:-1]] - (0 if own is None else own[0][:-1])
        unigram = (single + 1) / (total + len(self.ids))
        bigram = unigram.copy()
        seen = before > 0
        bigram[1:][seen] = pairs[seen] / before[seen]
        return float(-np.log2(MIX * bigram + (1 - MIX) * unigram).mean())


def encoded(docs: DataFrame, wanted: DataFrame, path: str, width: str, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, is_target, ids) with ids as numpy's ``width``; ``wanted``: distinct doc_ids."""
    # one way at every size, so that what is shuffled grows with the input alone
    flagged = texts(docs, id_col, text_col).hint("merge").join(wanted.withColumn("is_target", F.lit(True)), "doc_id", "left")
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(LibraryBackend, path)
        block, n = TaskContext.get().partitionId() << 32, 0
        for rows in rows_of(batches):
            blocks, ids = [], [np.frombuffer(raw, "<u4").astype(width).tobytes() for raw in enc.encode(rows["text"])]
            for raw in ids:
                size = 1 + len(raw) // np.dtype(width).itemsize
                if n and n + size > most:
                    block, n = block + 1, 0
                blocks.append(block)
                n += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(rows["doc_id"], pa.int64()),
                 pa.array([bool(x) for x in rows["is_target"]]), pa.array(ids, pa.binary())],
                names=["block", "doc_id", "is_target", "ids"])

    return flagged.mapInArrow(run, "block long, doc_id long, is_target boolean, ids binary")


def count_ids(ids: DataFrame, size: int, width: str) -> tuple[Counts, Counts]:
    """Target and background counts by id; ``size``: ids of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for rows in rows_of(batches):
            for k, raws in enumerate(([r for r, t in zip(rows["ids"], rows["is_target"]) if t], rows["ids"])):
                total[k] += np.bincount(np.frombuffer(b"".join(raws), width), minlength=size)
        key = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[0][key]), pa.array(total[1][key])],
                                         names=["key", "target", "background"])

    got = (ids.select("is_target", "ids").mapInArrow(run, "key long, target long, background long")
           .groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
           .toArrow())  # at most ``size`` rows
    out = []
    for name in ("target", "background"):
        n = np.zeros(size, np.int64)
        n[got["key"].to_numpy()] = got[name].to_numpy()
        out.append(Counts(n, int(n.sum())))
    return out[0], out[1]


def count_pairs(ids: DataFrame, width: str) -> DataFrame:
    """(block, pair, target, background): the corpus's counts of each block's bigrams.

    A block that is read in parts gives a bigram once for each part, each time with the same sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [])  # bigrams of the block's target documents and of all

        def counted() -> Iterator[pa.RecordBatch]:
            if held[1]:
                key, background = np.unique(np.concatenate(held[1]), return_counts=True)
                target = np.zeros(len(key), np.int64)
                if held[0]:
                    own, n = np.unique(np.concatenate(held[0]), return_counts=True)
                    target[np.searchsorted(key, own)] = n
                for k in range(0, len(key), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key[part]), block, np.int64)), pa.array(key[part]),
                         pa.array(target[part]), pa.array(background[part])],
                        names=["block", "pair", "target", "background"])
            held[0].clear()
            held[1].clear()

        for rows in rows_of(batches):
            for b, raw, is_target in zip(rows["block"], rows["ids"], rows["is_target"]):
                if b != block:
                    yield from counted()
                    block = b
                pairs = pairs_of(np.frombuffer(raw, width).astype(np.int64))
                if len(pairs):
                    held[1].append(pairs)
                    if is_target:
                        held[0].append(pairs)
        yield from counted()

    every = Window.partitionBy("pair")
    return (ids.select("block", "is_target", "ids")
            .mapInArrow(run, "block long, pair long, target long, background long")
            .select("block", "pair", F.sum("target").over(every).alias("target"),
                    F.sum("background").over(every).alias("background")))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", path: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row; label 1 marks the target."""
    path = path or default_path()
    spark = docs.sparkSession
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    wanted = (y.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
              .filter("lo = 1 and hi = 1").select("doc_id"))
    from tokenizers import Tokenizer
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    width = "<u2" if size <= 1 << 16 else "<u4"
    where = scratch_dir(spark, "lm")
    encoded(docs, wanted, path, width, id_col, text_col).write.parquet(where, compression="zstd")
    ids = spark.read.parquet(where)
    models = spark.sparkContext.broadcast(count_ids(ids, size, width))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        target, background = models.value
        key = found["pair"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, of_target, of_all = key[order], found["target"].to_numpy()[order], found["background"].to_numpy()[order]
        out = []
        for raw, is_target in zip(rows["ids"].to_pylist(), rows["is_target"].to_pylist()):
            own = np.frombuffer(raw, width).astype(np.int64)
            if not len(own):
                out.append((0, None, None, 0.0))
                continue
            pairs = pairs_of(own)
            at, mine = np.searchsorted(key, pairs), (own_counts(own), own_counts(pairs))
            t, b = target.loss(own, of_target[at], mine if is_target else None), background.loss(own, of_all[at], mine)
            out.append((len(own), t, b, b - t))
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([rows["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    found = count_pairs(spark.read.parquet(where), width)
    return ids.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
