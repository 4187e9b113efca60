"""Stored models and their pointers; the two ways of scoring; statistics of many training sets at once."""

import pytest
from pyspark.sql import functions as F

from textlab.functions.text import with_token_runs
from textlab.operators import model_store as MS
from textlab.operators import models as MD
from textlab.operators import sampling as SM
from textlab.session import scratch_dir

DOCS = "id int, text string, label int"
GOOD = [(1, "good fine", 1), (2, "bad sad", 0), (3, "good nice", 1)]
FLIPPED = [(1, "good fine", 0), (2, "bad sad", 1), (3, "good nice", 0)]


def one(spark, rows):
    return MD.nb_train(spark.createDataFrame(rows, DOCS), "text", "label")


def test_last_is_not_best(spark):
    root = scratch_dir(spark, "store")
    assert MS.manifest(spark, root).count() == 0
    with pytest.raises(LookupError):
        MS.resolve(spark, root, "r", 1)
    scores = [0.7, 0.9, 0.9, None, 0.4]
    for epoch, score in enumerate(scores):
        assert MS.save_nb(one(spark, GOOD if epoch < 4 else FLIPPED), root, "r", 1, epoch, score) == epoch
    MS.save_nb(one(spark, FLIPPED), root, "r", 2, 0, None)  # another seed has versions of its own
    rows = MS.versions(spark, root, "r", 1)
    assert [r.is_best for r in rows] == [True, True, True, False, False]  # a later tie wins, no score never does
    assert MS.resolve(spark, root, "r", 1, "best").version == 2 and MS.resolve(spark, root, "r", 1).version == 4
    assert MS.resolve(spark, root, "r", 1, 1).score == 0.9
    with pytest.raises(LookupError):
        MS.resolve(spark, root, "r", 2, "best")
    with pytest.raises(ValueError):
        MS.resolve(spark, root, "r", 1, "newest")
    docs = spark.createDataFrame([(1, "good"), (2, "sad"), (3, None), (4, "unknown")], "id int, text string")
    got = {}
    for which in MS.POINTERS:
        model, index = MS.load_nb(spark, root, "r", 1, which)
        got[which] = {r.id: r.y_pred for r in MD.nb_predict(model, docs, "id", "text").collect()}
        assert {(r.label, r.idx, r.n_docs) for r in index.collect()} == (
            {(0, 0, 1), (1, 1, 2)} if which == "best" else {(0, 0, 2), (1, 1, 1)})
    assert got["best"] == {1: 1, 2: 0, 3: 1, 4: 1} and got["last"] == {1: 0, 2: 1, 3: 0, 4: 0}


def test_a_reloaded_model_is_the_same(spark):
    root = scratch_dir(spark, "store")
    model = one(spark, GOOD)
    MS.save_nb(model, root, "r", 1)
    again, _ = MS.load_nb(spark, root, "r", 1)
    for t in ("token_table", "class_table"):
        assert sorted(map(str, getattr(model, t).collect())) == sorted(map(str, getattr(again, t).collect()))


def test_an_interrupted_save_is_not_seen(spark):
    root = scratch_dir(spark, "store")
    MS.save_nb(one(spark, GOOD), root, "r", 1, 0, 0.5)

    with pytest.raises(TypeError):  # after the tables were written, before the manifest row
        MS.save(root, "r", 1, {"counts": one(spark, FLIPPED).counts}, 1, 0.9, {"kind": object()})
    assert MS.resolve(spark, root, "r", 1).version == 0
    assert MS.save_nb(one(spark, FLIPPED), root, "r", 1, 1, 0.9) == 1
    assert MS.resolve(spark, root, "r", 1).epoch == 1
    with pytest.raises(ValueError):
        MS.save_nb(MD.nb_train(spark.createDataFrame(GOOD, DOCS), "text", "label", ["id"]), root, "r", 1)


def test_scoring_by_broadcast_equals_scoring_by_exchange(spark):
    rows = [(i, f"the w{i % 7} w{i % 7} x{i % 3}", i % 3) for i in range(300)]
    model = MD.nb_train(spark.createDataFrame(rows, DOCS), "text", "label")
    docs = spark.createDataFrame([(i, f"the the x{i % 3} w{i % 9} y") for i in range(50)] + [(50, None), (51, "")],
                                 "id int, text string")
    got = [{r.id: (r.y_pred, [round(x, 9) for x in r.scores]) for r in
            MD.nb_predict(model, docs, "id", "text", broadcast_pairs=n, salts=s).collect()} for n, s in ((10**6, 8), (0, 8), (0, 1))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 52


def test_token_runs(spark):
    df = spark.createDataFrame([(1, "B a b, b a c"), (2, ""), (3, None), (4, "one")], "id int, text string")
    got = {r.id: [(x.token, x.n) for x in r.runs] for r in with_token_runs(df, "text", "runs").where("id <> 3").collect()}
    assert got == {1: [("a", 2), ("b", 3), ("c", 1)], 2: [], 4: [("one", 1)]}


def test_bands_add_up_to_the_sizes(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    sizes = [50, 100, 200]
    bands = SM.size_bands(df, [7, 8], 1, "doc_id", sizes, 500).collect()
    for seed in (7, 8):
        for k, n in enumerate(sizes):
            assert sum(r.m for r in bands if r.seed == seed and r.band <= k) == n
    # the same draws as one seed's subsets, where the permutation has that seed too
    want = SM.subset_sizes(df, 7, "doc_id", sizes).where("n_train = 100").groupBy("doc_id").count().collect()
    own = SM.size_bands(df, [7], 7, "doc_id", sizes, 500).where("band <= 1").groupBy("doc_id").agg(F.sum("m").alias("m"))
    assert {r.doc_id: r["count"] for r in want} == {r.doc_id: r.m for r in own.collect()}
    assert SM.size_bands(df.limit(0), [7], 7, "doc_id", sizes, 0).count() == 0


def test_counts_of_uses_equal_separate_counts(spark):
    rows = [(1, "a b b"), (2, "c"), (3, None)]
    uses = [(1, "x", 0, 2), (1, "y", 1, 1), (2, "x", 1, 1), (3, "x", 0, 3)]
    texts = spark.createDataFrame(rows, "id int, text string")
    u = spark.createDataFrame(uses, "id int, model string, label int, m long")
    packed = u.groupBy("id").agg(F.collect_list(F.struct("model", "label", "m")).alias("uses"))
    got = MD.nb_counts_of_uses(packed.join(texts, "id"), "text", "uses", ["model"])
    plain = u.join(texts, "id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    want = MD.nb_counts(plain, "text", "label", ["model"])
    assert sorted(map(tuple, got.select("model", "label", F.coalesce("token", F.lit("-")), "n").collect())) == sorted(
        map(tuple, want.select("model", "label", F.coalesce("token", F.lit("-")), "n").collect()))
