"""Stored models: versions of a run's tables, with ``best`` and ``last`` pointers that readers resolve.

A store is a folder:

    data/<id>/<table>/     the tables of one version (token counts, label index, weights, ...)
    manifest/<id>/         one row: run_id, seed, version, epoch, score, is_best, data, tables, params

``save`` writes the tables first and the manifest row last; a version without
its row does not exist for readers, so an interrupted save leaves the store
as it was and its repetition makes a new version.  Nothing is renamed or
overwritten: ``last`` is the highest version of a (run, seed), ``best`` the
highest among those that scored at least as much as every version before
(a later tie wins; without a score a version is never best).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.models import NBModel, nb_from_counts

MANIFEST = ("run_id string, seed long, version long, epoch int, score double, is_best boolean, data string, "
            "tables array<string>, params string")
POINTERS = ("last", "best")


@dataclass
class Stored:
    """A resolved version: its manifest row and its tables as read from the store."""

    version: int
    epoch: int | None
    score: float | None
    is_best: bool
    params: dict
    tables: dict[str, DataFrame]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored version, in no order; no rows where nothing was stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifest")


def versions(spark: SparkSession, root: str, run_id: str, seed: int) -> list:
    """Manifest rows of one (run, seed), oldest first: a row an epoch or so, never data."""
    rows = manifest(spark, root).where((F.col("run_id") == run_id) & (F.col("seed") == seed)).collect()
    return sorted(rows, key=lambda r: r.version)


def save(root: str, run_id: str, seed: int, tables: dict[str, DataFrame], epoch: int | None = None,
         score: float | None = None, params: dict | None = None) -> int:
    """Store a version and return its number.

    Versions of one (run, seed) are meant to be stored one after another; of two that are stored at the same
    time both are kept under one number, and the later identifier is resolved.
    """
    if not tables:
        raise ValueError("a version needs a table at least")
    spark = next(iter(tables.values())).sparkSession
    earlier = versions(spark, root, run_id, seed)
    best = max((r.score for r in earlier if r.score is not None), default=None)
    is_best = score is not None and (best is None or score >= best)
    version, own = (earlier[-1].version + 1 if earlier else 0), uuid.uuid4().hex
    data = f"data/{own}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{data}/{name}")
    row = (run_id, seed, version, epoch, score, is_best, data, list(tables), json.dumps(params or {}, sort_keys=True))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{root}/manifest/{own}")
    return version


def resolve(spark: SparkSession, root: str, run_id: str, seed: int, which: str | int = "last") -> Stored:
    """The version that ``which`` points to: ``last``, ``best`` or a number."""
    rows = versions(spark, root, run_id, seed)
    if which == "best":
        rows = [r for r in rows if r.is_best]
    elif which != "last":
        if not isinstance(which, int):
            raise ValueError(f"unknown pointer {which!r}; use one of {POINTERS} or a version")
        rows = [r for r in rows if r.version == which]
    if not rows:
        raise LookupError(f"no {which} version of run {run_id!r}, seed {seed} under {root}")
    r = max(rows, key=lambda r: (r.version, r.data))
    return Stored(r.version, r.epoch, r.score, r.is_best, json.loads(r.params),
                  {t: spark.read.parquet(f"{root}/{r.data}/{t}") for t in r.tables})


def label_index(classes: DataFrame) -> DataFrame:
    """(label, idx, n_docs) of a model's class table: idx in order of label, among a model's few classes."""
    ordered = F.sort_array(F.collect_list(F.struct("label", "n_docs")))
    return classes.agg(ordered.alias("c")).select(F.posexplode("c").alias("idx", "c")).select("c.label", "idx", "c.n_docs")


def save_nb(model: NBModel, root: str, run_id: str, seed: int, epoch: int | None = None, score: float | None = None) -> int:
    """Store a naive Bayes model (one model, not a grid): its token counts and its label index."""
    if model.model_cols:
        raise ValueError("store the models of a grid one by one")
    return save(root, run_id, seed, {"counts": model.counts, "labels": label_index(model.class_table)}, epoch, score,
                {"kind": "naive_bayes", "alpha": model.alpha})


def load_nb(spark: SparkSession, root: str, run_id: str, seed: int, which: str | int = "last") -> tuple[NBModel, DataFrame]:
    """The model that a pointer resolves to, and its label index."""
    s = resolve(spark, root, run_id, seed, which)
    if s.params.get("kind") != "naive_bayes":
        raise ValueError(f"version {s.version} is no naive Bayes model")
    return nb_from_counts(s.tables["counts"], alpha=s.params["alpha"]), s.tables["labels"]
