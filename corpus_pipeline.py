"""Corpus pipeline: raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes every stage's result as Parquet to the shared
folder and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import classifier, near_dups, packing, quality_rules, secrets
from textlab.llm.common import table
from textlab.session import scratch_dir


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; NULL and empty texts have no words and go."""
    return quality_rules.keep_clean(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier calls good; all labelled documents of ``sf_dir`` teach it, also those that the
    rules reject.  Without labels of both kinds nothing is rejected."""
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: that of the least id, NULL ids last, repeated rows once."""
    return near_dups.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, NULL texts as they are, with their secrets masked."""
    return secrets.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, as op7 returns them; a NULL or empty text is its closing token, rows are packed each."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("near_dups", near_dups_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

#: No SQL expresses token ids or a boosted model's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
