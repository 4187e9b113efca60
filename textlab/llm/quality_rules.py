"""Quality rules: base measures and distribution divergence.

Two histograms describe a document: its characters by class, and its words
by the common words of its language (the last bin holds all other words).
Each is compared with the reference of the document's language by
Jensen-Shannon distance.  The references are summed over all documents of a
language in one pass (a few numbers per language and task are shuffled); a
document that states no language is held against its nearest reference, if it
is in Latin script like that one (the classes do not tell other scripts apart).

A short text's histogram strays from any reference by chance, so a
comparison needs a minimum length, and the divergence expected from sampling
alone, (bins - 1) / (8 n ln 2) bits, is taken off before the threshold.

Defined results: NULL and empty texts have no words, so the base rules
reject them; repeated rows get equal results; only the base rules decide, and
the distances are NULL, for a stated language whose reference has under
``MIN_REFERENCE`` words, and for no language where no reference fits; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import filter_rows, forget, rows_of, texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Frequent words of each language; a language that is not here is compared by characters only.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to a in is it that was he for on are as with his they at be".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "point", "mark", "letter", "other")
#: Characters of word ends and speech; every other visible ASCII character is a mark.
_POINT = ".,;:!?'\"()-"

#: Characters and words that a comparison needs at least.
MIN_CHARS, MIN_WORDS = 200, 50
#: Words that a reference needs at least.
MIN_REFERENCE = 2_000
#: Distances above which a document is rejected.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.21, 0.245


def _classes() -> np.ndarray:
    table = np.full(0x3001, CLASSES.index("letter"), np.uint8)  # the last entry is that of all from U+3000 on
    for c in range(0x80):
        ch = chr(c)
        kind = ("lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit()
                else "space" if ch in " \t\n\v\f\r" else "point" if ch in _POINT else "mark" if ch.isprintable() else "other")
        table[c] = CLASSES.index(kind)
    for c in range(0x80, 0x3000):
        ch = chr(c)
        if not ch.isalpha():
            table[c] = CLASSES.index("space" if ch.isspace() else "other")
        elif ch.isupper():
            table[c] = CLASSES.index("upper")
    return table


_CLASS = _classes()


def char_histogram(text: str) -> np.ndarray:
    """Characters by class; code points from U+3000 on count as letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_CLASS[np.minimum(points, len(_CLASS) - 1)], minlength=len(CLASSES))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _SPACES.search(text) else text.split()


def word_histogram(words: list[str], common: list[str]) -> np.ndarray:
    """Words by common word, without case and outer punctuation; the last bin holds the rest."""
    n = Counter(words)
    own = dict.fromkeys(common, 0)
    for w, k in n.items():
        if len(w) <= 12 and (w := w.strip(_POINT).lower()) in own:
            own[w] += k
    hits = list(own.values())
    return np.array([*hits, len(words) - sum(hits)])


def base_measures(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
            elif _WORD.search(line):
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        n, end = Counter(windows), 0
        for k, w in enumerate(windows):
            if n[w] > 1:
                repeats += k + 3 - max(k, end)
                end = k + 3
    return sum(map(len, words)), len(_SYMBOL.findall(text)), dup_lines, repeats


def distance(own: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms (base 2), less what ``own``'s size explains."""
    n = own.sum()
    p, q = own / n, reference / reference.sum()
    m = (p + q) / 2

    def part(a: np.ndarray) -> float:
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())

    bins = int(((own + reference) > 0).sum())
    return max(0.0, (part(p) + part(q)) / 2 - (bins - 1) / (8 * n * np.log(2))) ** 0.5


def references(docs: DataFrame, text_col: str = "text",
               lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """lang -> (characters, words) over all its documents of ``MIN_WORDS`` words or more, but for
    those with a symbol to every tenth word, which would make the reference a mixture.

    One row per language and task is shuffled; languages are those of
    ``COMMON`` plus the table's own, of which the summed table is collected
    (a row per language, bounded by the language column's domain).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[str, list[np.ndarray]] = {}
        for rows in rows_of(batches):
            for text, lang in zip(rows["text"], rows["lang"]):
                if lang is None or not text:
                    continue
                words = words_of(text)
                if len(words) < MIN_WORDS or 10 * len(_SYMBOL.findall(text)) > len(words):
                    continue
                own = [char_histogram(text), word_histogram(words, COMMON.get(lang, []))]
                total[lang] = [a + b for a, b in zip(total[lang], own)] if lang in total else own
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(total), pa.string()),
             "n": pa.array([np.concatenate(v).tolist() for v in total.values()], pa.list_(pa.int64()))})

    parts = texts(docs.select(F.lit(None).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")),
                  "id", "text", F.col("lang").cast("string").alias("lang"))
    summed = (parts.mapInArrow(run, "lang string, n array<long>")
              .select("lang", F.posexplode("n").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("n")))
    out = {}
    for r in summed.collect():
        n = np.array([x["n"] for x in r["n"]])
        if n[len(CLASSES):].sum() >= MIN_REFERENCE:
            out[r["lang"]] = (n[:len(CLASSES)], n[len(CLASSES):])
    return out


def _latin(chars: np.ndarray) -> bool:
    """Whether a histogram has no more letters outside ASCII (capitals apart) than others."""
    n = dict(zip(CLASSES, chars))
    return n["letter"] <= n["lower"] + n["upper"]


def judge(text: str, lang: str | None, known: dict) -> tuple:
    """All result columns after doc_id for one text."""
    words = words_of(text)
    n = len(words)
    word_chars, symbols, dup_lines, repeats = base_measures(text, words)
    failed = n < 50 or 100 * repeats > 50 * n
    chars = char_histogram(text)
    if lang is not None:
        near = [lang] if lang in known else []
    else:
        near = [x for x in known if _latin(chars) and _latin(known[x][0])]
    by_char = by_word = None
    if near and chars.sum() >= MIN_CHARS and n >= MIN_WORDS:
        by_char = min(distance(chars, known[x][0]) for x in near)
        by_word = min((distance(word_histogram(words, COMMON[x]), known[x][1]) for x in near if x in COMMON),
                      default=None)
    kept = not (failed or (by_char or 0) > MAX_CHAR_DISTANCE or (by_word or 0) > MAX_WORD_DISTANCE)
    return n, word_chars, symbols, dup_lines, repeats, failed, kept, by_char, by_word


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, char_distance double, word_distance double")


def score(docs: DataFrame, known: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """(doc_id, measures, base_failed, kept, distances); a distance is NULL where it was not taken."""
    known = references(docs, text_col, lang_col) if known is None else known
    names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [pa.int64(), *(kinds[x.split()[1]] for x in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            found = [(i, *judge(t, x, known)) for i, t, x in zip(rows["doc_id"], rows["text"], rows["lang"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    lang = F.col(lang_col).cast("string").alias("lang")
    return texts(docs, id_col, text_col, lang).mapInArrow(run, f"doc_id long, {RESULT}")


def keep_clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    known = references(docs, text_col, lang_col)

    def keep(row: dict) -> bool:
        return judge(row[text_col] or "", row[lang_col], known)[6]

    return filter_rows(docs, [text_col, lang_col], keep)
