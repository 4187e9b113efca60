"""The pipeline's stages, each on its own input."""

import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F

from test_near_dups import brute, crowd

from textlab.llm import catalog, near_dups
from textlab.llm.common import filter_rows, texts

SF = "/root/testdata/sf0.001"


def test_stages_and_registration(spark):
    import __spark_entry__ as e
    assert len(P.STAGES) == 5 and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in e.queries()}
    assert e.queries()["pipeline"] is P.run and set(catalog.oracle_sql()) <= set(e.queries())


def test_each_stage_takes_effect(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    extra = raw.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    docs, kept = raw.unionByName(extra), []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == raw.schema.names
        docs = out.persist()
        kept.append(docs.count())
    assert raw.count() > kept[0] >= kept[1] > kept[2] == kept[3] > 0
    assert docs.filter("text like '%token = \"%'").isEmpty()
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert P.run(spark, SF).agg(F.sum("length")).first()[0] > 0


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_dups_stage_keeps_one_of_each_class_of_a_crowd(spark, make):
    rows = crowd(200)
    kept = P.near_dups_stage(spark, make("doc_id long, text string", list(enumerate(rows))), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(rows)))


def test_workers_get_batches_of_bounded_bytes(spark):
    """2000 texts of 20,000 characters in one partition are no batch of 40 MB."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1819).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    own = texts(docs).mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in own) == 2000 and max(r["size"] for r in own) < 8 << 20


def test_stages_leave_nothing_in_the_workers_of_later_ones(spark, make):
    """Caches that grow with the texts (ids of pieces, hashes of words) go when another stage's task begins."""
    docs = make("doc_id long, text string", [(k, f"some words {k}") for k in range(64)]).repartition(8)

    def left(row):
        from textlab.llm import tokens
        return bool(tokens._ENCODERS or near_dups._WORDS)

    assert P.packing_stage(spark, docs, SF).count() > 0 and near_dups.sign(docs).agg(F.sum("size")).first()[0] > 0
    assert filter_rows(docs, ["text"], left).count() == 0
