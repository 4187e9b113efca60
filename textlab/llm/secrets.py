"""Secret scans: patterns, and compression novelty in sensitive contexts.

The patterns find named assignments, access keys and long hexadecimal
strings.  For every other unbroken string on either side of a sensitive name, the
marginal cost is measured: the bytes that zstandard, primed with a dictionary of
identifiers, needs for the surrounding text with the string less those
without it.  What surroundings and dictionary cannot explain costs almost a
byte per character and is reported, whole, as kind ``novel``.  What was found is
itself a sensitive place: the lines of a key, the parts of a dotted token and
the values of a list are followed from one to the next.

Parameters of the kind ``novel``: strings have ``SHORTEST`` characters at least and lie
within ``NEAR`` characters of a sensitive place; one with a digit is novel from
``NOVEL`` marginal bytes a character, one of letters and signs alone, which may be an
identifier that the dictionary does not know, from ``NOVEL_PLAIN``.

Defined results: NULL and empty texts hold nothing; repeated rows give equal
results; spans are in code points, end exclusive; a novel string that
overlaps a pattern's span is not reported again; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textlab.llm.common import map_rows, rows_of, texts

KINDS = ("assign", "access", "hex", "novel")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Names that make their surroundings sensitive.
SENSITIVE = ("key", "secret", "token", "passw", "pwd", "auth", "credential", "private", "bearer", "login", "signature")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
#: Characters between a string and a sensitive place, and those compressed on each side.
NEAR, AROUND = 40, 200
#: Characters of a string at least.
SHORTEST = 16
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: The short last line of a string in lines, the others of which have ``LINE`` characters at least.
LINE, _LAST = 40, re.compile(r"\r?\n([A-Za-z0-9+/_=-]{1,15})(?=\r?\n|\Z)")
_DIGIT = re.compile(r"[0-9]")
#: Marginal bytes per character from which a string is novel, with and without a digit.
NOVEL, NOVEL_PLAIN = 0.62, 0.9

_IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef fedcba9876543210 1234567890
xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 ................ ---------------- your_api_key_here changeme
example placeholder default undefined password secret token api_key access_key private_key public_key client_id
client_secret authorization bearer credential signature certificate session cookie username user_id account
config configuration environment settings production development testing localhost https://www.example.com/path
import export return function class const public private static void string integer boolean float double object
self.this.value length index count total size name type kind file path directory folder request response header
content message error exception warning information debug logging handler callback listener controller service
manager factory builder provider connection database table column query select insert update delete where order
""".strip().replace("\n", " ")

_COMPRESSOR: list = []


def _size(text: str) -> int:
    if not _COMPRESSOR:  # one for each Python worker
        import zstandard
        words = zstandard.ZstdCompressionDict(_IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _COMPRESSOR.append(zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False))
    return len(_COMPRESSOR[0].compress(text.encode("utf-8", "replace")))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes per character of text[start:end] in its surroundings."""
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    return (_size(before + after + text[start:end]) - _size(before + after)) / (end - start)


def _is_novel(text: str, a: int, b: int, names: list[tuple[int, int]]) -> bool:
    """Of the string text[a:b], or of what of it begins or ends a name inside it."""
    inside = names[bisect_left(names, (a, a)):bisect_left(names, (b, b))]
    return any(b - x >= SHORTEST and novelty(text, x, b) >= (NOVEL if _DIGIT.search(text, x, b) else NOVEL_PLAIN)
               for x in dict.fromkeys([a, *(x for name in inside for x in name)]))


def _novel(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The novel strings that lie near a sensitive name, or near a span that does."""
    names = [m.span() for m in _SENSITIVE.finditer(text)]
    joined: list[list[int]] = []  # the base spans, overlapping ones put together
    for a, b, _ in base:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    items, k = [(a, b, True) for a, b in joined], 0
    for m in _STRING.finditer(text):
        while k < len(joined) and joined[k][1] <= m.start():
            k += 1
        if k == len(joined) or joined[k][0] >= m.end():
            items.append((*m.span(), False))
    items.sort()
    verdicts: dict[tuple[int, int], bool] = {}

    def found(a: int, b: int, is_base: bool) -> bool:
        if not is_base and (a, b) not in verdicts:
            verdicts[a, b] = _is_novel(text, a, b, names)
        return is_base or verdicts[a, b]

    k, reach = 0, -1
    for a, b, is_base in items:
        while k < len(names) and names[k][0] < b:
            reach, k = max(reach, names[k][1] + NEAR), k + 1
        if a <= reach and found(a, b, is_base):
            reach = max(reach, b + NEAR)
    k, reach = len(names) - 1, len(text) + NEAR + 1
    for a, b, is_base in reversed(items):
        while k >= 0 and names[k][1] > a:
            reach, k = min(reach, names[k][0] - NEAR), k - 1
        if (verdicts.get((a, b)) or b >= reach) and found(a, b, is_base):
            reach = min(reach, a - NEAR)
    out = []
    for (a, b), is_novel in verdicts.items():
        if is_novel:
            out.append((a, b, "novel"))
            last = _LAST.match(text, b) if b - a >= LINE and text[a - 1:a] in ("", "\n") else None
            if last and not any(x < last.end(1) and last.start(1) < y for x, y in joined):
                out.append((*last.span(1), "novel"))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind."""
    low = text.lower()
    spans = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if any(n in low for n in _NAMES):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if any(n in low for n in SENSITIVE):
        spans += _novel(text, sorted(spans))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(found, kind)],
                                             names=["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def mask(text: str | None, by: str = "[SECRET]") -> str | None:
    """``text`` with every span, overlapping ones joined, replaced."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in find(text):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its secrets masked; ``length_col`` follows the new text."""
    def change(row: dict) -> dict:
        text = mask(row[text_col])
        out = {text_col: text}
        if length_col is not None:
            out[length_col] = row[length_col] if text == row[text_col] else len(text)
        return out

    return map_rows(docs, [text_col] + [length_col] * (length_col is not None), change)
