"""Streaming run of the stateless labelling path, and the pluggable scorer."""

import os
import shutil

import pandas as pd

from textlab.operators.zeroshot import lexicon_predict, scorer_predict
from textlab.streaming import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_root):
    src = os.path.join(tmp_root, "incoming")
    os.makedirs(src)
    shutil.copy(f"{SF}/documents.parquet", os.path.join(src, "part-0.parquet"))
    q = (score_stream(spark, src).writeStream.format("memory").queryName("scored")
         .option("checkpointLocation", os.path.join(tmp_root, "ckpt-stream")).outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.doc_id: r.y_pred for r in spark.sql("select doc_id, y_pred from scored").collect()}
    batch = lexicon_predict(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    want = {r.doc_id: r.y_pred for r in batch.select("doc_id", "y_pred").collect()}
    assert got == want and len(got) > 0


def test_pluggable_scorer(spark):
    df = spark.createDataFrame([(1, "aaa b"), (2, "bb bb"), (3, "")], "id int, text string")

    def scorer(texts: pd.Series, labels):
        return pd.DataFrame({lab: texts.str.count(lab) for lab in labels})

    got = {r.id: r.y_pred for r in scorer_predict(df, "text", ["a", "b"], scorer).collect()}
    assert got == {1: "a", 2: "b", 3: "a"}
