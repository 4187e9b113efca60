"""BPE by trie, decoding and packing against the library itself."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from textlab.llm import bpe, packing
from textlab.llm.tokens import LibraryBackend, TextEncoder, default_path

ALPHABET = ["a", "b", "e", "t", "h", "i", "n", "g", "s", "'", "é", "ß", "İ", "Σ", "ſ", "K", "1", "2", "٣", " ", "\n",
            "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​", "é", "힣", "ᄀ", "ᅡ", "日", "\U0001f600",
            ".", ",", "!", "<|endoftext|>", "<|startoftext|>", "</w>", "<", "|", "﻿", "\x00", "²", "½", "ª", "the", "ing", "'s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def trie():
    return bpe.TrieBackend(default_path())


def test_both_encoders_equal_the_library(library, trie):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 40))) for _ in range(3000)] + ["a" * 500, "abab" * 200]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for encoder in (TextEncoder(trie, max_cached=500), TextEncoder(LibraryBackend(default_path()))):
        got = [np.frombuffer(x, "<i4").tolist() for k in range(0, len(texts), 100) for x in encoder.encode(texts[k:k + 100])]
        assert got == want


def test_shared_prefixes_and_single_words_agree(trie):
    words = ["the", "then", "them", "theme", "thematic", "a", "ab", "abc"]
    together = trie.encode_words(words)
    assert all(together[w] == trie.encode_words([w])[w] for w in words)


def test_encode_and_decode_odd_rows(odd, none, library):
    out = bpe.decode(bpe.encode(odd)).collect()
    rows = odd.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in out) == want
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_decode_null_and_unknown_ids(make):
    rows = [(1, None), (2, [320, 10**9]), (3, []), (4, [-1, None, 320, 320]), (5, [None])]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(make("doc_id long, ids array<int>", rows)).collect()}
    assert got == {1: "", 2: "a</w>", 3: "", 4: "a</w> a</w>", 5: ""}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12288, 13001])
def test_pieces(n):
    out = packing.pieces_of(n)
    assert sum(k for _, k in out) == n and all(k & (k - 1) == 0 and k <= 4096 for _, k in out)
    assert [a for a, _ in out] == [sum(k for _, k in out[:i]) for i in range(len(out))]
    assert len({k for _, k in out if k < 4096}) == len([k for _, k in out if k < 4096])


def test_packing_covers_each_id_once(odd, none, library):
    out = packing.pack(odd).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        for a, k in packing.pieces_of(len(ids)):
            part = np.array(ids[a:a + k], "<u4").tobytes()
            want[r["doc_id"], a, k, zlib.crc32(part), len(ids)] += 1
    got = packing.digest(packing.pack(odd)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert packing.pack(none).count() == 0


def test_packing_buckets(odd, spark, tmp_path):
    packing.write_buckets(packing.pack(odd), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter("octet_length(ids) != 4 * length").count() == 0 and back.count() == packing.pack(odd).count()


def test_packing_rejects_other_lengths(odd):
    with pytest.raises(ValueError):
        packing.pack(odd, max_len=1000)


def test_new_words_go_to_the_library_in_lines():
    """Each word's ids are those it has alone, and the library is not called for each word."""
    back = LibraryBackend(default_path())
    own = random.Random(6)
    pieces = ["".join(own.choices("abcdeXYZ", k=own.randrange(1, 40))) for _ in range(300)]
    pieces += ["a", "ö", "中文", "'s", "...", "7", "<|endoftext|>", "q" * 5000, "x\x00y", "-", "z"]
    own.shuffle(pieces)
    want = [np.array(back.tok.encode(c, add_special_tokens=False).ids, "<i4").tobytes() for c in pieces]

    class Counted:
        given = 0

        def __getattr__(self, name):
            def f(some, **more):
                Counted.given += len(some)
                return getattr(back_tok, name)(some, **more)
            return f

    back_tok, back.tok = back.tok, Counted()
    assert back.encode(pieces) == want and Counted.given < 30
    assert back.encode([]) == [] and back.encode(["-"]) == [want[pieces.index("-")]]
