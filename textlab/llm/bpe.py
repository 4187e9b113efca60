"""BPE encoding and decoding by prefix-sharing trie traversal.

For a BPE vocabulary the encoding of a word's prefix ends in exactly one
token, and dropping that token leaves the encoding of a shorter prefix.
So a word is encoded by its *last tokens*: the last token of prefix ``p``
is the one token ``t`` that ends ``p`` and may follow the last token of
``p`` without ``t``.  The distinct words of a block of texts are inserted
into a trie; one depth-first walk hands the last tokens down from each node
to its children, so what several words begin with is worked out once.

``encode``: documents -> (doc_id, ids).  ``decode``: (doc_id, ids) ->
(doc_id, text).  Both are narrow maps: no shuffle, memory bounded by one
slice of a batch, one block of words and a bounded chunk cache.

Defined results: NULL or empty text has no ids and decodes to the empty
text; repeated rows give repeated rows; NULL ids decode to the empty text;
ids outside the vocabulary are skipped; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import rows_of, texts
from textlab.llm.tokens import default_path, encoder, plain_words

#: Stands for the vocabulary's end-of-word suffix inside the trie's strings.
_END = "\n"
#: Words that one trie holds at most.
BLOCK_WORDS = 20_000
#: The byte alphabet of byte-level vocabularies: bytes that are no visible Latin-1 character move to U+0100 and on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class TrieBackend:
    """Ids of chunks from a tokenizer file: BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok = Tokenizer.from_file(path)  # its normaliser and word splitter; the ids come from the trie
        suffix = model["end_of_word_suffix"]

        def own(token: str) -> str:
            return token.removesuffix(suffix) + _END if token.endswith(suffix) and token != suffix else token

        self.vocab = {own(t): i for t, i in model["vocab"].items()}
        self.string = {i: t for t, i in self.vocab.items()}
        self.length = {i: len(t) for t, i in self.vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[own(a)], self.vocab[own(b)]): (r, self.vocab[own(a + b)])
                     for r, (a, b) in enumerate(merges)}
        self.follows: dict[int, bool] = {}
        self.steps: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self.begins = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        #: tokens that their own string is encoded as
        self.reach = {t: i for t, i in self.vocab.items() if self._merged(self._symbols(t)) == [i]}
        added = self.tok.get_added_tokens_decoder()
        self.added = {a.content: i for i, a in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None

    def _symbols(self, s: str) -> list[int]:
        if s.endswith(_END) and len(s) > 1:
            return [self.vocab[c] for c in s[:-2]] + [self.vocab[s[-2:]]]
        return [self.vocab[c] for c in s]

    def _merged(self, ids: list[int]) -> list[int]:
        """Plain BPE of a few symbols: lowest rank first, leftmost first."""
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k:k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _may_follow(self, key: int) -> bool:
        a, b = key >> 20, key & 0xFFFFF
        if len(self.follows) > 500_000:  # bounded; only costs work
            self.follows.clear()
        ok = self.follows[key] = self._merged(self._symbols(self.string[a] + self.string[b])) == [a, b]
        return ok

    def _step(self, key: str) -> tuple[str, list[tuple[int, int]]]:
        """Of a text that ends in ``key``: its longest end that begins a token, and (length, id) of the
        reachable tokens that end it, longest first."""
        at = next((k for k in range(len(key)) if key[k:] in self.begins), len(key))
        ends = [(len(key) - k, self.reach[key[k:]]) for k in range(len(key)) if key[k:] in self.reach]
        if len(self.steps) > 300_000:
            self.steps.clear()
        self.steps[key] = found = (key[at:], ends)
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words (in the vocabulary's alphabet)."""
        trie: dict = {}
        for w in words:
            node = trie
            for c in w:
                node = node.setdefault(c, {})
            node[_END] = None
        out: dict[str, bytes] = {}
        steps, follows = self.steps, self.follows
        last, path = [0], ""  # last[k]: the last token of the first k characters of the path
        todo = [(0, "", c, child) for c, child in trie.items()]  # depth above, text matched above, edge, node
        while todo:
            depth, state, c, child = todo.pop()
            state, ends = steps.get(state + c) or self._step(state + c)
            del last[depth + 1:]
            depth += 1
            for k, t in ends:
                if k == depth:
                    break
                key = last[depth - k] << 20 | t
                ok = follows.get(key)
                if ok or ok is None and self._may_follow(key):
                    break
            else:
                raise ValueError(f"no encoding of {path[:depth - 1] + c!r}")
            last.append(t)
            path = path[:depth - 1] + c
            if child is None:
                ids, at = [], depth
                while at > 0:
                    ids.append(last[at])
                    at -= self.length[last[at]]
                out[path[:-1]] = np.array(ids[::-1], "<i4").tobytes()
            else:
                todo.extend([(depth, state, d, x) for d, x in child.items()])
        return out

    def split(self, text: str) -> list[str]:
        """Words and added tokens, as the file's normaliser and splitter give them."""
        words = plain_words(text)
        if words is not None:
            return words
        out: list[str] = []
        norm, pre = self.tok.normalizer.normalize_str, self.tok.pre_tokenizer.pre_tokenize_str
        for seg in self.cut.split(text) if self.cut else (text,):
            if seg in self.added:
                out.append(seg)  # no word can be one: it has both letters and symbols
            elif seg:
                seg = norm(seg)
                out.extend(seg[a:b] for w, (a, b) in pre(seg) if w)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        own = {w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_BYTE)
               for w in words if w not in self.added}
        fresh = sorted(own.values())
        known: dict[str, bytes] = {}
        gc.disable()  # the trie is many small objects without cycles
        try:
            for at in range(0, len(fresh), BLOCK_WORDS):
                known |= self.encode_words(fresh[at:at + BLOCK_WORDS])
        finally:
            gc.enable()
        return [known[own[w]] if w in own else np.array([self.added[w]], "<i4").tobytes() for w in words]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(TrieBackend, path)
        for rows in rows_of(batches):
            ids = enc.encode(rows["text"])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))],
                names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


_STRINGS: dict[str, pa.Array] = {}


def _strings(path: str) -> pa.Array:
    """This Python worker's table of token strings by id; NULL for numbers that are no token's."""
    if path not in _STRINGS:
        from tokenizers import Tokenizer
        strings = {i: t for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
        _STRINGS[path] = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.string())
    return _STRINGS[path]


def joined(ids: pa.Array, strings: pa.Array) -> pa.Array:
    """Token strings of lists of ids, joined by one space; ids that are no token's are skipped."""
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    flat = ids.flatten()
    number = flat.to_numpy(zero_copy_only=False)
    known = pc.fill_null(flat, -1).to_numpy() if flat.null_count else number
    taken = strings.take(pa.array(np.where((known >= 0) & (known < len(strings)), known, 0).astype(np.int64)))
    here = (known >= 0) & (known < len(strings)) & (taken.is_valid().to_numpy(zero_copy_only=False) if taken.null_count else True)
    if not here.all():
        taken = taken.filter(pa.array(here))
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[here], minlength=len(counts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), " ")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the vocabulary has no decoder, so tokens are joined by one space, as its library does."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), joined(part.column(1), strings)],
                                                 names=["doc_id", "ids", "text"])

    cols = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return cols.mapInArrow(run, "doc_id long, ids array<int>, text string")
