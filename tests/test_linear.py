"""The epoch-wise learner: its log, its stored states, and what it refuses."""

import math

import pytest
from pyspark.sql import functions as F

from textlab.operators import linear as LN
from textlab.operators import model_store as MS
from textlab.session import scratch_dir

ROWS = [(i, "train" if i % 5 else "val", int(i % 3 == 0), "spam offer now" if i % 3 == 0 else "plain words here") for i in range(60)]


def rows_of(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id int, part string, label int, text string")
    return LN.with_features(df, "text", 16).select("doc_id", "part", "label", "feats")


def test_features(spark):
    got = {r.doc_id: {f.f: f.x for f in r.feats} for r in rows_of(
        spark, [(1, "train", 0, "a a b"), (2, "train", 0, None), (3, "train", 1, "")]).collect()}
    assert got[2] == got[3] == {0: 1.0} and got[1][0] == 1.0
    assert math.isclose(sum(got[1].values()) - 1, 16) and max(got[1].values()) == 32 / 3


def test_epochs_log_and_pointers(spark):
    folder = scratch_dir(spark, "fit")
    fit = LN.fit(rows_of(spark), "doc_id", folder, "r", 7, 16, epochs=3, steps=2, rate=0.05)
    log = sorted(fit.log(spark, None).collect(), key=lambda r: (r.part, r.epoch))
    assert [(r.part, r.epoch, r.n) for r in log] == [("train", e, 48) for e in range(3)] + [("val", e, 12) for e in range(3)]
    train = [r.loss for r in log if r.part == "train"]
    assert math.log(2) > train[0] > train[1] > train[2]
    # the loss is that of the stored probabilities
    stored = fit.stored(spark).where("epoch = 2 and part = 'val'").collect()
    loss = sum(-r.weight * math.log(r.p[r.y]) for r in stored) / len(stored)
    assert math.isclose(loss, log[-1].loss) and all(math.isclose(sum(r.p), 1) for r in stored)
    # balanced weights average to one over the train rows
    first = fit.stored(spark).where("epoch = 0 and part = 'train'")
    assert math.isclose(first.agg(F.avg("weight")).first()[0], 1)
    versions = MS.versions(spark, f"{folder}/models", "r", 7)
    assert [v.epoch for v in versions] == [0, 1, 2] and all(v.score is not None for v in versions)
    # the last state, read back, predicts what the last epoch stored
    docs = spark.createDataFrame(ROWS, "doc_id int, part string, label int, text string")
    again = {r.doc_id: r.p for r in LN.predict(LN.load(spark, folder, "r", 7), docs, "text").collect()}
    last = {r.doc_id: r.p for r in fit.stored(spark).where("epoch = 2").collect()}
    assert all(math.isclose(a, b, rel_tol=1e-12) for k in last for a, b in zip(last[k], again[k]))
    best = MS.resolve(spark, f"{folder}/models", "r", 7, "best")
    assert best.score == max(v.score for v in versions)


def test_without_validation_there_is_no_best(spark):
    folder = scratch_dir(spark, "fit")
    LN.fit(rows_of(spark, [(i, "train", y, t) for i, _, y, t in ROWS[:20]]), "doc_id", folder, "r", 7, 16, epochs=1)
    assert MS.resolve(spark, f"{folder}/models", "r", 7).score is None
    with pytest.raises(LookupError):
        LN.load(spark, folder, "r", 7, "best")


def test_refusals(spark):
    with pytest.raises(ValueError, match="missing from train"):
        LN.fit(rows_of(spark, [*ROWS, (99, "val", 5, "x")]), "doc_id", scratch_dir(spark, "fit"), "r", 7, 16, epochs=1)
    with pytest.raises(ValueError, match="more than"):
        LN.fit(rows_of(spark), "doc_id", scratch_dir(spark, "fit"), "r", 7, 1 << 20, epochs=1)
