"""Operator quirks on tiny hand-made frames."""

import os

from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators import prep as P
from textlab.sources import io as IO


def test_tweet_cleaner_cases(spark):
    cases = [("RT @bob: see https://t.co/abc?x=1 now", ": see now"),
             ("@@abcdefghijklmnopq hi", "hi"),
             ("a  b", "a b"),
             ("x\x1c\x1cy", "x y"),
             ("@über1 z", "z"),
             ("  two lead", "two lead"),
             ('say "hi"', "say hi"),
             ("ART x", "Ax")]
    df = spark.createDataFrame(cases, "x string, want string")
    for r in df.select(T.clean_tweet("x").alias("got"), "want").collect():
        assert r.got == r.want


def test_python_whitespace_classes(spark):
    df = spark.createDataFrame([("　 a  b \x1f",)], "x string")
    r = df.select(T.py_strip("x").alias("s"), T.collapse_ws("x").alias("c")).first()
    assert r.s == "a  b" and r.c == " a b "


def test_normalise_ws_removes_dashes_first(spark):
    df = spark.createDataFrame([("a --- b",)], "x string")
    assert df.select(T.normalise_ws("x")).first()[0] == "a b"


def test_concat_context_asymmetric(spark):
    df = spark.createDataFrame([("b", "c", "a"), (None, "c", None)], "b string, c string, a string")
    assert [r[0] for r in df.select(T.concat_context("b", "c", "a")).collect()] == ["b ca", " c"]


def test_line_readers(spark, tmp_root):
    path = os.path.join(tmp_root, "x.csv")
    with open(path, "w") as f:
        f.write('"a, b"\n\n  lead \nNA\n"he said ""x"""\n')
    raw = [r.line for r in IO.read_raw_lines(spark, path).orderBy("pos").collect()]
    assert raw == ['"a, b"', "", "  lead ", "NA", '"he said ""x"""']
    lab = IO.read_labelled_lines(spark, path).orderBy("pos").collect()
    assert [r.line for r in lab] == ['"a, b"', "lead", None, '"he said ""x"""']
    assert [r.pos for r in lab] == [0, 1, 2, 3]


def test_positional_alignment_fails_on_length_mismatch(spark, tmp_root):
    import pytest
    xp, yp = os.path.join(tmp_root, "ax.csv"), os.path.join(tmp_root, "ay.csv")
    with open(xp, "w") as f:
        f.write("t1\n\nt2\nt3\n")
    with open(yp, "w") as f:
        f.write("0\n1\n0\n1\n")
    x = IO.read_labelled_lines(spark, xp)
    y = IO.with_position(IO.read_labels(spark, yp))
    with pytest.raises(ValueError):
        IO.align_positional(x, y)
    ok = IO.align_positional(IO.read_raw_lines(spark, xp), y).orderBy("pos").collect()
    assert [(r.line, r.label) for r in ok] == [("t1", 0), ("", 1), ("t2", 0), ("t3", 1)]


def test_position_over_many_splits(spark, tmp_root):
    path = os.path.join(tmp_root, "big.txt")
    with open(path, "w") as f:
        for i in range(200_000):
            f.write(f"line{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = IO.read_raw_lines(spark, path)
        assert df.rdd.getNumPartitions() > 4
        bad = df.where(F.col("line") != F.concat(F.lit("line"), F.col("pos").cast("string"))).count()
        assert bad == 0 and df.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vote_ties_null_keys_null_votes(spark):
    rows = [("a", 1), ("a", 1), ("a", 0), ("b", 1), ("b", 0), (None, 1), ("c", None), ("d", None), ("d", 0)]
    df = spark.createDataFrame(rows, "k string, v int")
    keep = {r.k: (list(r.modes), r.n_votes) for r in P.vote_keep_ties(df, ["k"], "v").collect()}
    assert keep == {"a": ([1], 3), "b": ([0, 1], 2), "c": ([], 0), "d": ([0], 1)}
    drop = {r.k: r.label for r in P.vote_drop_ties(df, ["k"], "v").collect()}
    assert drop == {"a": 1, "d": 0}
    neutral = {r.k: r.label for r in P.vote_neutral(df, ["k"], "v", neutral=9).collect()}
    assert neutral == {"a": 1, "b": 9, "c": 9, "d": 0}


def test_polar_vote_then_binary(spark):
    rows = [("s1", 1), ("s1", 1), ("s2", -1), ("s3", 0), ("s4", 1), ("s4", -1)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r.label for r in P.binary_from_polar(P.vote_neutral(df, ["k"], "v")).collect()}
    assert got == {"s1": 1, "s2": 0}


def test_recode_override_with_null(spark):
    rows = [(1.0, None), (2.0, None), (3.0, None), (4.0, None), (5.0, None), (None, 1.0), (None, 2.0), (1.0, 2.0),
            (None, None)]
    df = spark.createDataFrame(rows, "num double, k double")
    got = [r[0] for r in df.select(P.recode_override("num", "k")).collect()]
    assert got == [0, 1, 2, 2, 5, 1, 1, 1, None]


def test_band_and_threshold(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (None,)], "h double")
    kept = df.where(P.band_filter("h", 2.0, 3.0)).select(P.threshold_label("h", 3.0).alias("y"), "h").collect()
    assert [(r.h, r.y) for r in kept] == [(1.0, 0), (3.0, 1)]


def test_drop_first_group_variants(spark):
    df = spark.createDataFrame([("", 0), ("b", 1), ("a", 1)], "text string, y int")
    assert sorted(r.text for r in P.drop_first_group(df, ["text"], positional=True).collect()) == ["a", "b"]
    assert sorted(r.text for r in P.drop_first_group(df, ["text"]).collect()) == ["a", "b"]


def test_handle_fixpoint_matches_python_re(spark):
    import random
    import re
    rng = random.Random(7)
    alphabet = ["@", "@", "a", "b", "ü", "_", "1", " ", ".", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts.append("@" * 3000 + "abc")  # many '@': cost stays bounded by passes actually needed

    def py(x):
        while re.search(r"@\w{2,15}", x):
            x = re.sub(r"@\w{2,15}", "", x)
        return x

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", T.remove_handles("x").alias("y")).collect()}
    assert got == {i: py(t) for i, t in enumerate(texts)}


def test_bucketed_tables_join_without_exchange(spark, tmp_root):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    d = IO.save_bucketed(docs, "bk_documents", "doc_id", 8, os.path.join(tmp_root, "bk_documents"))
    lab = IO.save_bucketed(labels, "bk_labels", "doc_id", 8, os.path.join(tmp_root, "bk_labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = d.join(lab, "doc_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == labels.join(docs, "doc_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
