"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Both tokenizers cut the same bytes (a space, then the text).  Where a token
of A and a token of B end at the same byte the text is *cut*; the tokens
between two cuts are a group, and every A token of a group is linked with
every B token of it.

``align`` merges the byte ends of many documents at once.  One state vector
holds the A pointer and the B pointer of each open lane; a step compares the
ends under all pointers, emits a cut where they are equal, and advances the
smaller (or both).  Lanes that have come to their end are compacted away.  A
long document is dealt to several lanes at byte offsets where both tokens are
seen to end, so that it does not hold up its batch.

``count_links`` says in how many documents of a corpus each (A id, B id)
pair is linked.  Documents are aligned once and stored in blocks of about
``BLOCK_BYTES`` of text: each document's linked pairs as places in its
block's list of pairs.  Only those lists (a row a block and pair, already
counted in the block) are shuffled to sum the counts, summed again before
the shuffle, and joined with the sums on the way back; a pair that every
block holds is one that Spark's skew join splits.  Texts never move; the
compact blocks are shuffled once, to meet their sums.

Defined results: a text that is NULL or empty, or whose joined token bytes
differ from the space and the text (a vocabulary that rewrites characters),
has no tokens: zeros, and an empty digest.  Ties for an A id's highest count
all are best.  Repeated rows count as documents each; NULL doc_ids are kept;
an empty table gives an empty table.  Texts are encoded and aligned whole; a
single text longer than a block is a block of its own, and a group's pairs
are counted by distinct ids, so a long run of odd symbols costs no square.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import texts
from textlab.session import scratch_dir

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of one block, and of one lane.
BLOCK_BYTES, LANE_BYTES = 4 << 20, 2048
#: Groups of more links than this are counted by distinct ids.
LARGE_GROUP = 256


def _path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@dataclass
class Encoded:
    """Tokens of several texts: ids one after another, and where each text's begin (with the end)."""

    ids: np.ndarray
    starts: np.ndarray


class _Vocabulary:
    """Byte strings of a vocabulary's ids."""

    def _table(self, strings: list[bytes]) -> None:
        self.strings = pa.array(strings, pa.large_binary())
        self.lengths = np.array([len(s) for s in strings], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after another."""
        if not len(ids):
            return b""
        taken = self.strings.take(pa.array(ids))
        _, ends, data = taken.buffers()
        return bytes(data)[:np.frombuffer(ends, "<i8", len(taken) + 1)[-1]] if data is not None else b""


#: The byte alphabet of byte-level vocabularies: bytes that are no visible Latin-1 character move to U+0100 and on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class ByteLevel(_Vocabulary):
    """A byte-level BPE file; ids by tiktoken, of the ranks that the file's merges have."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {chr(b): b for b in _VISIBLE}
        byte |= {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        strings = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            strings[i] = s
        self._table(strings)

    def encode(self, texts: list[str]) -> Encoded:
        return _encoded([np.array(self.tok.encode_ordinary(" " + t) if t else [], np.int32) for t in texts])


class Pieces(_Vocabulary):
    """A sentencepiece model; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)

        def own(i: int) -> bytes:
            piece = self.tok.id_to_piece(i)
            if self.tok.is_byte(i):
                return bytes([int(piece[3:5], 16)])
            return b"" if self.tok.is_control(i) or self.tok.is_unknown(i) else piece.replace("▁", " ").encode()

        self._table([own(i) for i in range(self.tok.get_piece_size())])

    def encode(self, texts: list[str]) -> Encoded:
        return _encoded([np.array(self.tok.encode(t) if t else [], np.int32) for t in texts])


def _encoded(each: list[np.ndarray]) -> Encoded:
    ids = np.concatenate(each) if each else np.empty(0, np.int32)
    return Encoded(ids, np.cumsum([0, *map(len, each)]).astype(np.int64))


_KNOWN: dict[tuple, _Vocabulary] = {}


def _vocabulary(kind: type, path: str) -> _Vocabulary:
    """This Python worker's vocabulary of a file."""
    if (kind, path) not in _KNOWN:
        _KNOWN[kind, path] = kind(path)
    return _KNOWN[kind, path]


def _lanes(raw: bytes, ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int]]:
    """(A token, B token) at which a lane of a document begins: where a space follows a letter or the like, and
    both tokens before it end there."""
    out, at = [(0, 0)], LANE_BYTES
    while at < len(raw):
        at = raw.find(b" ", at)
        if at < 0:
            break
        i, j = int(np.searchsorted(ends_a, at)), int(np.searchsorted(ends_b, at))
        if ends_a[i] == at == ends_b[j] and i + 1 < len(ends_a):
            out.append((i + 1, j + 1))
            at += LANE_BYTES
        else:
            at += 1
    return out


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
          last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cuts of all lanes: the (A token, B token) that end at each, ascending.

    ``ends_*``: byte ends of all tokens, comparable within a lane; ``first_*``: a lane's first tokens; ``last_a``: its
    last A token, which ends where its last B token does.
    """
    i, j, to_i = first_a.astype(np.int64), first_b.astype(np.int64), last_a
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    while len(i):
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        if cut.any():
            at_a, at_b = i[cut], j[cut]
            cuts.append((at_a, at_b))
            over = at_a == to_i[cut]
            if over.any():  # compacted: only lanes with tokens left go on
                going = np.ones(len(i), bool)
                going[np.flatnonzero(cut)[over]] = False
                i, j, to_i, a, b = i[going], j[going], to_i[going], a[going], b[going]
        i = i + (a <= b)
        j = j + (b <= a)
    if not cuts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at_a, at_b = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


@dataclass
class Aligned:
    """Groups of several documents.  Per group: its document and its token ranges; per document: what was asked."""

    a: Encoded
    b: Encoded
    doc: np.ndarray
    from_a: np.ndarray
    n_a: np.ndarray
    from_b: np.ndarray
    n_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id, B id, times) of linked ids; an id pair may stand several times for a document."""
        small = self.n_a * self.n_b <= LARGE_GROUP
        doc, from_a, n_a, from_b, n_b = (x[small] for x in (self.doc, self.from_a, self.n_a, self.from_b, self.n_b))
        each_a = _ranges(from_a, n_a)  # each A token, then its group's B tokens
        times = np.repeat(n_b, n_a)
        b = _ranges(np.repeat(from_b, n_a), times)
        out = [(np.repeat(np.repeat(doc, n_a), times), np.repeat(self.a.ids[each_a], times), self.b.ids[b],
                np.ones(len(b), np.int64))]
        for k in np.flatnonzero(~small):
            a, many_a = np.unique(self.a.ids[self.from_a[k]:self.from_a[k] + self.n_a[k]], return_counts=True)
            b, many_b = np.unique(self.b.ids[self.from_b[k]:self.from_b[k] + self.n_b[k]], return_counts=True)
            out.append((np.full(len(a) * len(b), self.doc[k]), np.repeat(a, len(b)), np.tile(b, len(a)),
                        np.repeat(many_a, len(b)) * np.tile(many_b, len(a))))
        return tuple(np.concatenate(c) for c in zip(*out))

    def pieces(self) -> np.ndarray:
        """Tokens in the order in which groups list them: A tokens as 2 * index, B tokens as 2 * index + 1."""
        n = self.n_a + self.n_b
        ends = np.cumsum(n)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        start = ends - n
        out[_ranges(start, self.n_a)] = 2 * _ranges(self.from_a, self.n_a)
        out[_ranges(start + self.n_a, self.n_b)] = 2 * _ranges(self.from_b, self.n_b) + 1
        return out


def aligned(texts: list[str], va: _Vocabulary, vb: _Vocabulary) -> Aligned:
    """All texts' groups; a text without tokens has none."""
    raws = [b" " + t.encode() if t else b"" for t in texts]
    a, b = va.encode(texts), vb.encode(texts)
    lengths_a, lengths_b = va.lengths[a.ids], vb.lengths[b.ids]
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    bytes_a, bytes_b = va.joined(a.ids), vb.joined(b.ids)
    to_a, to_b = np.concatenate([[0], ends_a]), np.concatenate([[0], ends_b])
    lanes: list[list[int]] = [[], [], []]
    own_a, own_b = np.empty_like(ends_a), np.empty_like(ends_b)
    for k, raw in enumerate(raws):
        (x, y), (u, v) = a.starts[k:k + 2], b.starts[k:k + 2]
        if not raw or bytes_a[to_a[x]:to_a[y]] != raw or bytes_b[to_b[u]:to_b[v]] != raw:
            continue
        own_a[x:y], own_b[u:v] = ends_a[x:y] - to_a[x], ends_b[u:v] - to_b[u]
        begins = _lanes(raw, own_a[x:y], own_b[u:v])
        lanes[0] += [x + i for i, _ in begins]
        lanes[1] += [u + j for _, j in begins]
        lanes[2] += [x + i - 1 for i, _ in begins[1:]] + [y - 1]
    first_a, first_b, last_a = (np.array(x, np.int64) for x in lanes)
    at_a, at_b = align(own_a, own_b, first_a, first_b, last_a)
    doc = np.searchsorted(a.starts, at_a, "right") - 1
    # a group begins after the cut before it, or where its document does
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    from_a, from_b = np.empty_like(at_a), np.empty_like(at_b)
    from_a[1:], from_b[1:] = at_a[:-1] + 1, at_b[:-1] + 1
    from_a[new], from_b[new] = a.starts[doc[new]], b.starts[doc[new]]
    return Aligned(a, b, doc, from_a, at_a - from_a + 1, from_b, at_b - from_b + 1)


class _Printed:
    """Group lists as text: ids in order, tokens joined by commas, A and B by a bar, groups by a semicolon."""

    def __init__(self, va: _Vocabulary, vb: _Vocabulary):
        na, nb = len(va.lengths), len(vb.lengths)
        #: A id with a comma, A id with a bar, B id with a comma, B id with a semicolon
        self.strings = pa.array([b"%d%c" % (k, c) for n, cs in ((na, b",|"), (nb, b",;")) for c in cs for k in range(n)],
                                pa.large_binary())
        self.at = (0, na, 2 * na, 2 * na + nb)

    def digests(self, x: Aligned, docs: int) -> list[str]:
        order = x.pieces()
        is_b, token = order & 1, order >> 1
        ends = np.cumsum(x.n_a + x.n_b)
        bar, semicolon = ends - x.n_b - 1, ends - 1
        at = np.where(is_b == 1, self.at[2], self.at[0])
        at[bar], at[semicolon] = self.at[1], self.at[3]
        ids = np.empty(len(order), np.int64)
        ids[is_b == 0], ids[is_b == 1] = x.a.ids[token[is_b == 0]], x.b.ids[token[is_b == 1]]
        out = [""] * docs
        if not len(order):
            return out
        taken = self.strings.take(pa.array(ids + at))
        _, places, data = taken.buffers()
        places, data = np.frombuffer(places, "<i8", len(taken) + 1), memoryview(data)
        last = np.flatnonzero(np.append(x.doc[1:] != x.doc[:-1], True))  # last group of each document
        start = 0
        for k in last.tolist():
            end = int(places[ends[k]])
            out[x.doc[k]] = hashlib.sha256(data[start:end - 1]).hexdigest()  # without the last semicolon
            start = end
        return out


_PRINTED: dict[tuple, _Printed] = {}
_BLOCK = ("block long, pairs binary, docs binary, doc_ids array<long>, counts array<struct<n_a:long,n_b:long,n_groups:long,"
          "n_links:long>>, digests array<string>, links binary")


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of about ``size`` bytes."""
    doc_ids: list = []
    held: list[str] = []
    n = 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            if held and n + len(text) > size:
                yield doc_ids, held
                doc_ids, held, n = [], [], 0
            doc_ids.append(batch.column(0)[k].as_py())
            held.append(text)
            n += len(text) + 64
    if held:
        yield doc_ids, held


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Aligned documents in blocks.

    A block: its distinct linked pairs (A id in the upper 32 bits), in how many of its documents each is linked,
    and per document id, counts, digest of its groups and its own linked pairs (place in the block's list, times).
    """
    path_a, path_b = path_a or _path(BYTE_BPE), path_b or _path(PIECE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = _vocabulary(ByteLevel, path_a), _vocabulary(Pieces, path_b)
        if (path_a, path_b) not in _PRINTED:
            _PRINTED[path_a, path_b] = _Printed(va, vb)
        printed = _PRINTED[path_a, path_b]
        block = TaskContext.get().partitionId() << 32
        for doc_ids, held in _slices(batches, BLOCK_BYTES):
            x, n = aligned(held, va, vb), len(held)
            doc, a, b, times = x.links()
            pairs, place = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
            own, at = np.unique(doc * max(1, len(pairs)) + place, return_inverse=True)
            times = np.bincount(at, times, len(own)).astype("<u4")
            of_doc, place = np.divmod(own, max(1, len(pairs)))
            in_docs = np.bincount(place, minlength=len(pairs)).astype("<i8")

            def summed(values: np.ndarray) -> list[int]:
                return np.bincount(x.doc, values, n).astype(np.int64).tolist()

            ends = np.searchsorted(of_doc, np.arange(n + 1))
            links = b"".join([ends.astype("<i8").tobytes(), place.astype("<u4").tobytes(), times.tobytes()])
            counts = pa.StructArray.from_arrays([pa.array(summed(v), pa.int64()) for v in (
                x.n_a, x.n_b, np.ones(len(x.doc)), x.n_a * x.n_b)], names=["n_a", "n_b", "n_groups", "n_links"])
            whole = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([pairs.astype("<i8").tobytes()], pa.binary()),
                 pa.array([in_docs.tobytes()], pa.binary()), pa.ListArray.from_arrays(whole, pa.array(doc_ids, pa.int64())),
                 pa.ListArray.from_arrays(whole, counts), pa.ListArray.from_arrays(whole, pa.array(printed.digests(x, n))),
                 pa.array([links], pa.binary())],
                names=["block", "pairs", "docs", "doc_ids", "counts", "digests", "links"])
            block += 1

    return texts(docs, id_col, text_col).mapInArrow(run, _BLOCK)


def count_links(found: DataFrame) -> DataFrame:
    """(block, place, docs, best) for each block's list of pairs: the corpus-wide count of documents that hold the
    pair linked, and whether it is the highest of its A id."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(batch.column(k) for k in range(3))):
                key, n = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(docs.as_buffer(), "<i8")
                for k in range(0, len(key), 1 << 16):
                    part = key[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block.as_py(), np.int64)), pa.array(np.arange(k, k + len(part), dtype=np.int32)),
                         pa.array(part), pa.array(n[k:k + len(part)])], names=["block", "place", "pair", "docs"])

    rows = found.select("block", "pairs", "docs").mapInArrow(listed, "block long, place int, pair long, docs long")
    sums = rows.groupBy("pair").agg(F.sum("docs").alias("total"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as the vocabulary of B has ids, at most
    sums = sums.select("pair", "total", (F.col("total") == F.max("total").over(of_a)).alias("best"))
    return rows.select("block", "place", "pair").join(sums, "pair").select("block", "place", F.col("total").alias("docs"), "best")


def score(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best``: links whose pair's count is its A id's highest; ``count_sum``: sum of the counts over the links.
    """
    where = scratch_dir(docs.sparkSession, "aligned")
    blocks(docs, path_a, path_b, id_col, text_col).write.parquet(where, compression="zstd")
    found = docs.sparkSession.read.parquet(where)

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        held = np.zeros(sums.num_rows, np.int64)
        best = np.zeros(sums.num_rows, bool)
        place = sums["place"].to_numpy()
        held[place], best[place] = sums["docs"].to_numpy(), sums["best"].to_numpy(zero_copy_only=False)
        out = []
        for k in range(own.num_rows):
            doc_ids, raw = own["doc_ids"][k].values, own["links"][k].as_buffer()
            n = len(doc_ids)
            ends = np.frombuffer(raw, "<i8", n + 1)
            place = np.frombuffer(raw, "<u4", ends[-1], 8 * (n + 1))
            times = np.frombuffer(raw, "<u4", ends[-1], 8 * (n + 1) + 4 * int(ends[-1])).astype(np.int64)

            def summed(values: np.ndarray) -> pa.Array:
                total = np.concatenate([[0], np.cumsum(values)])
                return pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())

            counts = own["counts"][k].values
            out.append(pa.table([doc_ids, *(counts.field(c) for c in ("n_a", "n_b", "n_groups", "n_links")),
                                 summed(times * best[place]), summed(times * held[place]), own["digests"][k].values],
                                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out) if out else _NONE.empty_table()

    own = found.select("block", "doc_ids", "counts", "digests", "links")
    return own.groupBy("block").cogroup(count_links(found).groupBy("block")).applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


_NONE = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                   ("groups_sha256", pa.string())])
