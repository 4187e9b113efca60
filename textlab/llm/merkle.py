"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the digest of its columns.  The leaves of a tree (a
source) are ordered and numbered; 16 consecutive nodes make one node of the
next level until one is left; the trees' roots, in order, make one tree more.

A node's label is (its last leaf, its level): children come before their
parent.  *Forward sweep*: nodes are visited by label, and each sends its
digest to its parent; a priority queue keyed by the receiver's label hands a
node all its children's digests when its turn comes.  *Reversed sweep*:
nodes are visited by falling label, and each sends its children the suffix
of their proof: their siblings, then the node's own suffix.  Leaves end up
with their whole proof.

The queue is external: a tree is cut into blocks of 16**``LEVELS`` leaves;
inside a block a heap delivers, between blocks Spark's sorted shuffle does.
A block's top is a leaf of the next tier, so a tier has 1/4096 of the rows
of the one below, and no task holds more than a block and the path above it.
Hot trees are thus split; leaves are numbered by a range sort with counts a
range, never by a window over a whole tree.

Defined results: NULL columns count as ``-``; NULL trees and ids come first;
rows of one id are ordered by digest, then by the tampered digest, so that
ties and repeated rows give the same set of results however rows are stored;
NULL ids are never tampered with; an empty table gives no rows; texts of any
length are hashed as they are, in the JVM.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import rows_of
from textlab.session import scratch_dir, ship_package

#: Children of a node, and the levels of a block.
FAN, LEVELS = 16, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left:string,right:string>>"


def digest_of(*values: Column) -> Column:
    """Hex sha256 of the values as text, each with its length in bytes before it; NULL is ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered) of documents; ``tampered`` is NULL where nothing was changed.

    Tampering: where 5 divides the crc32 of the decimal id, the text's A-Z become lower case.
    """
    ship_package(docs.sparkSession)
    doc_id, text, n_chars = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("n_chars").cast("long")

    def digest(t: Column) -> Column:
        return digest_of(doc_id, F.col("source"), F.col("lang"), n_chars, t)

    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return docs.select(F.col("source").cast("string").alias("tree"), doc_id.alias("doc_id"), digest(text).alias("digest"),
                       F.when(chosen & text.rlike("[A-Z]"), digest(F.translate(text, _UPPER, _LOWER))).alias("tampered"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, f"merkle-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``at``, their place in their tree, and ``n``, the tree's leaves.

    A range sort puts a tree's rows in order over any number of partitions; each range's count, a row a
    tree and range, gives the places.
    """
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written, so that counts and rows come from one and the same cut into ranges
    ranged = _written(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")),
                      "sorted")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("k"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("tree").alias("its_tree"), F.col("range").alias("its_range"), "first",
                           before.alias("before"), F.sum("k").over(tree).alias("n"))
    own = F.col("tree").eqNullSafe(F.col("its_tree")) & (F.col("range") == F.col("its_range"))
    return ranged.join(counts, own).select(*nodes.columns, (F.col("row") - F.col("first") + F.col("before")).alias("at"), "n")


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _label(level: int, k: int, n: int) -> tuple[int, int]:
    return min((k + 1) * FAN ** level, n) - 1, level


def forward(digests: list[str], whole: bool) -> dict[tuple[int, int], list[str]]:
    """The run of children digests of every node of a block, by (level, number).

    ``whole``: the block is a tree of its own, which ends at its first lone node; else it has ``LEVELS`` levels.
    """
    n, runs, queue = len(digests), {}, []
    top = 0
    while (n > FAN ** top) if whole else top < LEVELS:
        top += 1
    for leaf, digest in enumerate(digests):
        at, level, k = (leaf, 0), 0, leaf
        while True:
            if level < top:  # time forward: to the parent, whenever its label comes
                heapq.heappush(queue, (_label(level + 1, k // FAN, n), k, digest))
            if not queue or queue[0][0] > (leaf, top):
                break
            at, run = queue[0][0], []
            while queue and queue[0][0] == at:
                _, k, digest = heapq.heappop(queue)
                run.append(digest)
            level, k = at[1], k // FAN
            runs[level, k], digest = run, _hash(run)
    return runs


def top_of(digests: list[str], runs: dict[tuple[int, int], list[str]]) -> str:
    return _hash(runs[max(runs)]) if runs else digests[0]


def backward(digests: list[str], runs: dict[tuple[int, int], list[str]], path: list[dict]) -> Iterator[tuple[int, tuple]]:
    """(leaf, its path) by falling label; a path is a chain (left, right, rest) of siblings, lowest level first."""
    n, chain = len(digests), ()
    for step in reversed(path):
        chain = (step["left"], step["right"], chain)
    level = max(runs)[0] if runs else 0
    first = _label(level, 0, n)
    queue = [((-first[0], -level), 0, chain)]
    while queue:
        label, k, chain = heapq.heappop(queue)
        level = -label[1]
        if not level:
            yield k, chain
            continue
        run = runs[level, k]
        for j in range(len(run)):
            at = _label(level - 1, k * FAN + j, n)
            own = ("".join(run[:j]), "".join(run[j + 1:]), chain)
            heapq.heappush(queue, ((-at[0], -at[1]), k * FAN + j, own))


def fold(digest: str, chain: tuple) -> str:
    """The root that a leaf's digest and its path lead to."""
    while chain:
        left, right, chain = chain
        digest = _hash([left, digest, right])
    return digest


def proof(chain: tuple) -> str:
    """Digest of all siblings on a path, level by level."""
    parts = []
    while chain:
        left, right, chain = chain
        parts += (left, right)
    return _hash(parts)


def _blocks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each block, from rows sorted by ``keys``."""
    own, held = None, []
    for rows in rows_of(batches, 1 << 12):
        for values in zip(*rows.values()):
            row = dict(zip(rows, values))
            key = tuple(row[c] for c in keys)
            if held and key != own:
                yield own, held
                held = []
            own = key
            held.append(row)
    if held:
        yield own, held


def _dealt(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes by block, each block in order (messages to a block, numbered -1, come first)."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at", *more)


_SIZE = FAN ** LEVELS


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, digest) of the next tier: the forward sweep's result for each block of (tree, at, n, digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in _blocks(batches, "tree", "block"):
            digests = [r["digest"] for r in rows]
            n = rows[0]["n"]
            out.append((tree, block, -(-n // _SIZE), top_of(digests, forward(digests, n <= _SIZE))))
            if len(out) >= 1 << 12:
                yield _batch(out, ["tree", "at", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])
                out = []
        yield _batch(out, ["tree", "at", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    own = nodes.select("tree", F.floor(F.col("at") / _SIZE).alias("block"), "at", "n", "digest")
    return _dealt(own).mapInArrow(run, "tree string, at long, n long, digest string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tiers above them; the last has one node a tree, its root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while True:
        up = _written(tops(out[-1]), "tier")
        out.append(up)
        most = -(-most // _SIZE)
        if most <= 1:
            return out
        # trees that have ended stay as single nodes: a lone leaf is its own root


_PATH_KIND = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _messages(nodes: DataFrame, sent: DataFrame, *carried: str) -> DataFrame:
    """Nodes together with what is sent to their blocks: (tree, at, path, subroot, root)."""
    own = nodes.select("tree", F.floor(F.col("at") / _SIZE).alias("block"), "at", "digest", *carried, "n",
                       F.lit(None).cast(_STEP).alias("path"), F.lit(None).cast("string").alias("subroot"),
                       F.lit(None).cast("string").alias("root"))
    to = sent.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"),
                     F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast(nodes.schema[c].dataType).alias(c)
                                                                  for c in carried], F.lit(None).cast("long").alias("n"),
                     "path", "subroot", "root")
    return _dealt(own.unionByName(to))


def sent_down(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    """(tree, at, path, subroot, root) for every node: the reversed sweep of a tier, given that of the tier above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["tree", "at", "path", "subroot", "root"]
        kinds = [pa.string(), pa.int64(), _PATH_KIND, pa.string(), pa.string()]
        for (tree, block), (message, *rows) in _blocks(batches, "tree", "block"):
            digests = [r["digest"] for r in rows]
            for k, chain in backward(digests, forward(digests, rows[0]["n"] <= _SIZE), message["path"]):
                path = []
                while chain:
                    left, right, chain = chain
                    path.append({"left": left, "right": right})
                out.append((tree, rows[k]["at"], path, message["subroot"], message["root"]))
                if len(out) >= 256:
                    yield _batch(out, names, kinds)
                    out = []
        yield _batch(out, names, kinds)

    return _messages(nodes, sent).mapInArrow(run, f"tree string, at long, path {_STEP}, subroot string, root string")


def proofs(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the numbered leaves."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, (message, *rows) in _blocks(batches, "tree", "block"):
            digests, root = [r["digest"] for r in rows], message["root"]
            for k, chain in backward(digests, forward(digests, rows[0]["n"] <= _SIZE), message["path"]):
                row = rows[k]
                folded = fold(row["tampered"] or row["digest"], chain)
                out.append((row["doc_id"], row["digest"], message["subroot"], root, proof(chain), folded, folded == root))
            while len(out) >= 1 << 12:
                yield _batch(out[:1 << 12], names, kinds)
                out = out[1 << 12:]
        yield _batch(out, names, kinds)

    return _messages(nodes, sent, "doc_id", "tampered").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and checked proofs of all documents (doc_id, source, lang, n_chars, text)."""
    spark = docs.sparkSession
    by_source = tiers(_written(numbered(leaves(docs), ["doc_id", "digest", "tampered"]), "leaves"))
    # the trees' roots in the order of their sources, as one tree more
    order = by_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    roots = tiers(_written(numbered(order, ["source"]), "roots"))
    root = roots[-1].first()
    if root is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    sent = roots[-1].select("tree", "at", F.array().cast(_STEP).alias("path"), F.lit("").alias("subroot"),
                            F.col("digest").alias("root"))
    for tier in reversed(roots[:-1]):
        sent = _written(sent_down(tier, sent), "paths")
    # each source's path goes to its own top
    sent = (roots[0].select("at", "source", "digest").join(sent.select("at", "path", "root"), "at")
            .select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "path",
                    F.col("digest").alias("subroot"), "root"))
    for tier in reversed(by_source[1:-1]):
        sent = _written(sent_down(tier, sent), "paths")
    return proofs(by_source[0], sent)
