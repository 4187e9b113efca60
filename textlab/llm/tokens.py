"""Token ids of whole texts, computed once per distinct piece of text.

The public vocabulary drops white space and never joins characters across
it, so a text's ids are the ids of its pieces one after another.
``TextEncoder`` keeps the ids of the pieces it has met (a bounded cache, one
per Python worker) and hands new ones to a back end: the tokenizers library
itself, or the trie of ``bpe.py``.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import regex

from textlab.llm.common import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work, not the library

#: Words that the library encodes at once.
LINE = 64

#: The vocabulary that the registered queries use.
WORD_BPE = "word_bpe_49k.json"

#: White space as the vocabulary's normaliser has it (Unicode White_Space);
#: str.split() also splits at U+001C..U+001F.
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = regex.compile(r"[\x1c-\x1f]")


#: Letters of which normalising and lower-casing make one letter each: ASCII, up to U+017F (without the one
#: that lower-cases to two), Chinese characters.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f\u4e00-\u9fa5"
_PLAIN = re.compile(f"[\t-\r -~\u2010-\u2027{_LETTER}]*")
#: The vocabulary's words, for texts of these characters.
_WORD = re.compile(f"[{_LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r 0-9{_LETTER}]+")


def plain_words(text: str) -> list[str] | None:
    """The words that the vocabulary's normaliser and splitter make of a text of common characters without
    added tokens; None for any other text."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _WORD.findall(text.lower())
    return None


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(WORD_BPE)


def chunks_of(text: str) -> list[str]:
    """Maximal runs without white space."""
    if _ODD.search(text):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


class LibraryBackend:
    """Ids by the tokenizers library, of words or of white-space separated chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    @staticmethod
    def split(text: str) -> list[str]:
        words = plain_words(text)
        return chunks_of(text) if words is None else words

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each piece; words of ASCII letters go to the library in lines of ``LINE``, whose ids are cut by
        where their words begin."""
        out = [b""] * len(chunks)
        words = [k for k, c in enumerate(chunks) if c.isascii() and c.isalpha()]
        lines = [words[k:k + LINE] for k in range(0, len(words), LINE)]
        for line, e in zip(lines, self.tok.encode_batch([" ".join(chunks[k] for k in line) for line in lines],
                                                        add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *(len(chunks[k]) + 1 for k in line[:-1])])
            cuts = np.searchsorted([a for a, _ in e.offsets], [*starts, starts[-1] + len(chunks[line[-1]]) + 1]).tolist()
            raw = np.array(e.ids, "<i4").tobytes()
            for k, a, b in zip(line, cuts, cuts[1:]):
                out[k] = raw[4 * a:4 * b]
        others = [k for k, c in enumerate(chunks) if not (c.isascii() and c.isalpha())]
        for k, e in zip(others, self.tok.encode_batch_fast([chunks[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<i4").tobytes()
        return out


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit integers.

    ``max_cached`` pieces of at most ``max_piece`` characters are kept.
    """

    def __init__(self, backend, max_cached: int = 600_000, max_piece: int = 64):
        self.backend, self.max_cached, self.max_piece = backend, max_cached, max_piece
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.backend.split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > self.max_cached:
            self.known = {}
            new = set(chain.from_iterable(split))
        fresh = list(new)
        self.known.update(zip(fresh, self.backend.encode(fresh), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, cs)) for cs in split]
        for c in fresh:
            if len(c) > self.max_piece:
                del self.known[c]
        return out


_ENCODERS: dict[tuple, TextEncoder] = {}
CACHES.append(_ENCODERS)


def encoder(backend: type, path: str) -> TextEncoder:
    """This Python worker's encoder for a vocabulary file."""
    if (key := (backend.__name__, path)) not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(backend(path))
    return _ENCODERS[key]
