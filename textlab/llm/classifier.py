"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins.  Shallow trees are boosted
in turn over the features, a small step each time, and every tree is added
to its feature's lookup table; then the pairs of features that explain most
of what is left get tables of two dimensions the same way.  A score is the
logistic of the intercept and one table entry per feature and pair, looked
up for a whole batch at once.

Fitting takes at most ``max_rows`` labelled rows (those whose doc_id hashes
lowest), whose features alone reach the driver; scoring is a narrow map.

Defined results: NULL and empty texts are scored by their (zero) features;
rows with NULL labels, NULL ids or conflicting labels teach nothing; without
both classes the score is the mean label (0.5 with no label at all);
repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import rows_of, texts
from textlab.session import ship_package

FEATURES = ("log_words", "word_length", "marks", "upper", "digits", "space", "non_ascii", "bare_marks", "mark_ends",
            "distinct", "same_word_run", "repeated_triples", "dup_lines", "line_words", "short_words")
_MARK = re.compile(r"[^\w\s.,;:!?'\"()-]|_|!!+")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def features(text: str) -> list[float]:
    """Measures of a whole text; shares are of its words or characters."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    triples = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    run = max((sum(1 for _ in g) for _, g in groupby(words)), default=0)
    ends = Counter(w[-1] for w in words)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, len(_MARK.findall(text)) / n,
        len(_UPPER.findall(text)) / chars, len(_DIGIT.findall(text)) / chars, (chars - sum(map(len, words))) / chars,
        (len(text.encode("utf-8", "replace")) - len(text)) / chars,
        sum(not w[0].isalnum() and len(w) == 1 for w in words) / n,
        sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,") / n,
        len(set(words)) / n, run / n, 1 - len(set(triples)) / max(len(triples), 1),
        1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), sum(len(w) < 4 for w in words) / n,
    ]


@dataclass
class Model:
    """``cuts[f]``: bin edges; ``tables[f]``: log-odds by bin; ``pairs``: (f, g, edges, edges, table)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cut, x[:, f], "right")]
        for f, g, cf, cg, table in self.pairs:
            z += table[np.searchsorted(cf, x[:, f], "right"), np.searchsorted(cg, x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where cutting the bins raises the second-order gain most; 0: nowhere."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton step of each bin by a tree of ``depth`` over the bins' order."""
    k = _best_cut(g, h) if depth else 0
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The tree that cuts the first feature, then the second on either side, with the greatest gain; that gain."""
    best, gain = np.zeros_like(g), 0.0
    for k in range(len(g)):
        own = np.zeros_like(g)
        for part in (slice(None, k), slice(k, None)) if k else (slice(None),):
            own[part] = _tree(g[part].sum(0), h[part].sum(0), 1)
        if (new := float((own * g).sum())) > gain:
            best, gain = own, new
    return best, gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 32, pair_bins: int = 8,
        n_pairs: int = 6) -> Model:
    """Cyclic boosting of main effects, then of the strongest pairs, under logistic loss."""
    mean = float(y.mean()) if len(y) else 0.5
    if not 0 < mean < 1 or not len(y):
        return Model(float(np.clip(np.log((mean + 1e-9) / (1 - mean + 1e-9)), -30, 30)),
                     [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    z = np.full(len(y), np.log(mean / (1 - mean)))
    model = Model(float(z[0]), [_edges(c, bins) for c in x.T], [], [])
    at = [np.searchsorted(cut, c, "right") for cut, c in zip(model.cuts, x.T)]
    model.tables = [np.zeros(len(cut) + 1) for cut in model.cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in zip(at, model.tables):
            if len(table) > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(k, g, len(table)), np.bincount(k, h, len(table)), 2)
                table += step
                z += step[k]
    coarse = [_edges(c, pair_bins) for c in x.T]
    low = [np.searchsorted(cut, c, "right") for cut, c in zip(coarse, x.T)]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        wide = len(coarse[k]) + 1
        return np.bincount(low[f] * wide + low[k], v, (len(coarse[f]) + 1) * wide).reshape(-1, wide)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(f, k, g), grid(f, k, h))[1], f, k)
                    for f, k in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(f, k, coarse[f], coarse[k], np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)))
                   for _, f, k in gains[:n_pairs]]
    for _ in range(rounds // 2):
        for f, k, _, _, table in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(f, k, g), grid(f, k, h))[0]
            table += step
            z += step[low[f], low[k]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 modulo 4 (a NULL id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _with_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["label"], pa.int32()),
                 pa.array([features(t) for t in rows["text"]], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return docs.mapInArrow(run, "doc_id long, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows that are not held out, at most ``max_rows`` of them."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    y = (y.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
         .filter("label = most").select("doc_id", "label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    y = y.orderBy(*order).limit(max_rows)
    own = texts(docs, id_col, text_col).join(F.broadcast(y), "doc_id")  # max_rows rows at most
    rows = _with_features(own).orderBy(*order, "x").limit(max_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float))


#: Score from which a document counts as good.
GOOD = 0.7


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            s = model.score(np.array([features(t) for t in rows["text"]], float))
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(s)],
                                             names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``GOOD`` or more.

    NULL texts are scored as empty ones; equal rows have equal verdicts; an empty table stays empty.  A model that
    learnt nothing (no labelled rows, or one class alone) rejects nothing.
    """
    if not any(len(table) > 1 for table in model.tables):
        return docs
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = np.array([features(t or "") for t in part.column(at).to_pylist()], float)
                yield part.filter(pa.array(model.score(x) >= GOOD))

    return docs.mapInArrow(run, docs.schema)
