"""Continuous labelling of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import clean_tweet
from textlab.operators.zeroshot import LEXICON, LEXICON_LABELS, lexicon_predict

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def label_documents(df: DataFrame, text: str = "text", labels=LEXICON_LABELS, lexicon=LEXICON,
                    clean: bool = False) -> DataFrame:
    """Batch or streaming: optional cleaning, then the lexicon label."""
    src = df.withColumn(text, clean_tweet(text)) if clean else df
    return lexicon_predict(src, text, labels, lexicon)


def score_stream(spark: SparkSession, source_dir: str, schema: str = DOC_SCHEMA,
                 max_files_per_trigger: int = 100, clean: bool = False) -> DataFrame:
    """Streaming DataFrame of (doc_id, y_pred) over Parquet files arriving in
    ``source_dir``; start it with ``writeStream`` and a checkpoint location."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    return label_documents(stream, clean=clean).select("doc_id", "y_pred", F.current_timestamp().alias("scored_at"))
