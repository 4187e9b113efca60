"""Property tests of the samplers, weights and scorers."""

from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.operators import sampling as SM
from textlab.operators.zeroshot import answer_loop, map_text

N = 3000


def data(spark, parts=7):
    df = spark.range(N).select(F.col("id").alias("doc_id"), (F.col("id") % 10 < 3).cast("int").alias("label"))
    return df.repartition(parts)


def test_rank_is_permutation_and_partition_independent(spark):
    a = {r.doc_id: r.pos for r in SM.seeded_rank(data(spark, 3), 7, "doc_id", bucket_digits=2).collect()}
    b = {r.doc_id: r.pos for r in SM.seeded_rank(data(spark, 11), 7, "doc_id", bucket_digits=3).collect()}
    assert a == b and sorted(a.values()) == list(range(N))


def test_holdout_complement_partition(spark):
    df = data(spark)
    h = SM.holdout(df, 1234, "doc_id", 200)
    a = SM.complement(df, h, "doc_id")
    hs, as_ = {r.doc_id for r in h.collect()}, {r.doc_id for r in a.collect()}
    assert len(hs) == 200 and not (hs & as_) and len(hs | as_) == N
    ranked = {r.doc_id for r in SM.seeded_rank(df, 1234, "doc_id").where("pos < 200").collect()}
    assert ranked == hs


def test_split_sizes(spark):
    s = SM.split_train_val(data(spark), 5, "doc_id", 0.9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": int(0.9 * N), "val": N - int(0.9 * N)}


def test_resample_sizes_and_membership(spark):
    df = data(spark)
    up = SM.resample(df, 3, "doc_id", "label", "upsampling")
    counts = {r.label: r["count"] for r in up.groupBy("label").count().collect()}
    assert counts == {0: 2100, 1: 2100}
    assert up.where((F.col("doc_id") % 10 < 3).cast("int") != F.col("label")).count() == 0
    under = SM.resample(df, 3, "doc_id", "label", "undersampling")
    assert {r.label: r["count"] for r in under.groupBy("label").count().collect()} == {0: 900, 1: 900}
    import pytest
    with pytest.raises(ValueError):
        SM.resample(df, 3, "doc_id", "label", "smote")


def test_subset_prefix_property(spark):
    s = SM.subset_sizes(data(spark), 1234, "doc_id", [50, 100])
    small = {(r.i, r.doc_id) for r in s.where("n_train = 50").collect()}
    big = {(r.i, r.doc_id) for r in s.where("n_train = 100").collect()}
    assert len(small) == 50 and len(big) == 100 and small <= big


def test_class_weights_average_to_one(spark):
    df = data(spark)
    w = M.class_weights(df, "label")
    avg = SM.weight_rows(df, w, "label").agg(F.avg("w")).first()[0]
    assert abs(avg - 1.0) < 1e-12


def test_weighted_recall_equals_accuracy(spark):
    df = data(spark).withColumn("y_pred", (F.col("doc_id") % 7 < 2).cast("int"))
    r = M.classification_report(df, [], "label", "y_pred", digits=None).first()
    assert abs(r.recall - r.accuracy) < 1e-12


def test_answer_loop_bounded_retries(spark):
    import pandas as pd
    df = spark.createDataFrame([("p1",), ("p2",)], "prompt string")

    def fn(prompts: pd.Series, attempt: int) -> pd.Series:
        return prompts.map(lambda p: "'a'" if p == "p1" else "nonsense")

    out = {r.prompt: r for r in answer_loop(df, "prompt", fn, ["a", "b"], max_attempts=3).collect()}
    assert out["p1"].y_pred == 0 and out["p1"].attempts == 1
    assert out["p2"].y_pred is None and out["p2"].attempts == 3 and out["p2"].error == "unknown label"


def test_map_text_fallback_and_passthrough(spark):
    import pandas as pd
    df = spark.createDataFrame([(1, "de", "ok"), (2, "de", "boom"), (3, "en", "keep")], "id int, lang string, t string")

    def fn(s: pd.Series) -> pd.Series:
        if (s == "boom").any():
            raise RuntimeError("service error")
        return s.str.upper()

    got = {r.id: r.text_out for r in map_text(df, "t", fn, F.col("lang") == "de").collect()}
    assert got == {1: "OK", 2: "", 3: "keep"}


def test_windows_keep_null_keys_and_orders(spark):
    from pyspark.sql import Window

    from textlab.operators.windows import lag_lead, running_agg
    rows = [(k, o, v) for k in ("a", "b", None) for o, v in ((None, 5), (1, None), (2, 3), (300, 1), (301, None))]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    w = Window.partitionBy("k").orderBy("o")
    key = ["k", "o"]
    for hot in (0, 100):  # every key hot, none
        for fn, agg in (("sum", F.sum), ("max", F.max), ("min", F.min)):
            want = df.select(*key, agg("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
            got = running_agg(df, ["k"], "o", "v", fn, out="x", block_bits=4, hot_rows=hot).select(*key, "x")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (hot, fn)
        want = df.select(*key, F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
        got = lag_lead(df, ["k"], "o", "v", "p", "n", block_bits=4, hot_rows=hot).select(*key, "p", "n")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), hot


def test_user_functions_are_called_by_position_and_row_by_row(spark):
    import pandas as pd

    rows = [(k, None if k == 6 else f"t{k}") for k in range(9)]

    def tag(texts):  # a fresh index, and a refusal
        if (texts == "t3").any():
            raise ValueError("no")
        return pd.Series(["T" + x if x else None for x in texts])

    def answer(prompts, attempt):
        if (prompts == "t3").any():
            raise ValueError("no")
        return pd.Series([None if p is None else "'a'" if int(p[1:]) % 2 or attempt > 1 else "?" for p in prompts])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "id long, t string").repartition(parts)
        got = {r.id: r.text_out for r in map_text(df, "t", tag, F.col("id") != 5, fallback="").collect()}
        assert got == {k: "" if k in (3, 6) else "t5" if k == 5 else f"Tt{k}" for k in range(9)}
        out = answer_loop(df, "t", answer, ["a"], max_attempts=2)
        got = {r.id: (r.y_pred, r.attempts) for r in out.collect()}
        assert got == {k: (None, 2) if k in (3, 6) else (0, 1 if k % 2 else 2) for k in range(9)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    from textlab.operators.zeroshot import answer_again, unresolved
    assert {r.id for r in unresolved(out).collect()} == {3, 6}
    again = answer_again(out, "t", lambda p, k: ["a"] * len(p), ["a"])
    assert again.where("y_pred = 0").count() == 9


def test_votes_with_unknown_winner_and_ties(spark):
    from textlab.operators import prep as P
    rows = [("u", 99), ("u", 99), ("u", 1), ("p", 1), ("n", -1), ("n", -1), ("t", 1), ("t", -1), ("z", None), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r.label for r in P.vote_neutral(df, ["k"], "v", codes=[1, 0, -1]).collect()}
    assert got == {"u": 0, "p": 1, "n": -1, "t": 0, "z": 0}
    got = {r.k: r.label for r in P.binary_from_polar(P.vote_neutral(df, ["k"], "v", codes=[1, 0, -1])).collect()}
    assert got == {"p": 1, "n": 0}
    assert {r.k: r.label for r in P.vote_drop_ties(df, ["k"], "v").collect()} == {"u": 99, "p": 1, "n": -1}
    modes = {r.k: (r.modes, r.n_modes, r.n_votes) for r in P.vote_modes(df, ["k"], "v").collect()}
    assert modes == {"u": ([99], 1, 3), "p": ([1], 1, 1), "n": ([-1], 1, 2), "t": ([-1, 1], 2, 2), "z": ([], 0, 0)}


def test_running_agg_matches_plain_window_with_hot_key(spark):
    from pyspark.sql import Window

    from textlab.operators.windows import running_agg
    # key 0 holds a third of all rows; order values spread over many blocks
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7 + 3).alias("o"), ((F.col("id") * 13) % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    for fn, agg, hot in (("sum", F.sum, 500), ("max", F.max, 0), ("min", F.min, 10**9)):
        want = {(r.k, r.o): (r.want, r.tot) for r in df.select(
            "k", "o", agg("v").over(w).alias("want"), agg("v").over(Window.partitionBy("k")).alias("tot")).collect()}
        got = {(r.k, r.o): (r.running, r.tot) for r in
               running_agg(df, ["k"], "o", "v", fn, total="tot", block_bits=6, hot_rows=hot).collect()}
        assert got == want


def test_lag_lead_matches_window_across_blocks(spark):
    from pyspark.sql import Window

    from textlab.operators.windows import lag_lead
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 5).alias("o"),
                                  F.when(F.col("id") % 17 == 0, None).otherwise(F.col("id").cast("string")).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = {(r.k, r.o): (r.p, r.n) for r in df.select("k", "o", F.lag("v").over(w).alias("p"),
                                                      F.lead("v").over(w).alias("n")).collect()}
    hot = 0
    got = {(r.k, r.o): (r.prev, r.next) for r in lag_lead(df, ["k"], "o", "v", block_bits=5, hot_rows=hot).collect()}
    assert got == want


def test_nb_many_models_equal_separate_models(spark):
    from textlab.operators import models as MD
    rows = [("m", True, 1, "good fine great", 1), ("m", True, 1, "bad awful", 0), ("m", True, 1, "great good", 1),
            ("m", False, 2, "bad bad", 0), ("m", False, 2, "fine", 1), ("m", False, 2, "awful great", 0)]
    df = spark.createDataFrame(rows, "s string, b boolean, i int, text string, label int")
    docs = spark.createDataFrame([(1, "good great"), (2, "awful bad"), (3, "unknown words")], "id int, text string")
    multi = MD.nb_train(df, "text", "label", model_cols=["s", "b", "i"])
    got = {(r.b, r.id): (r.y_pred, [round(x, 9) for x in r.scores]) for r in
           MD.nb_predict(multi, docs, "id", "text").collect()}
    for b in (True, False):
        single = MD.nb_train(df.where(F.col("b") == b), "text", "label")
        for r in MD.nb_predict(single, docs, "id", "text").collect():
            assert got[(b, r.id)] == (r.y_pred, [round(x, 9) for x in r.scores])


def test_nb_salted_join_equals_unsalted_with_hot_token(spark):
    from textlab.operators import models as MD
    # "the" is a third of all training tokens and in every document to score
    train = spark.createDataFrame([(i, f"the w{i % 7} x{i % 3}", i % 2) for i in range(300)], "id int, text string, label int")
    docs = spark.createDataFrame([(i, f"the x{i % 3} w{i % 5}") for i in range(500)], "id int, text string")
    m = MD.nb_train(train, "text", "label")
    a = {r.id: r.y_pred for r in MD.nb_predict(m, docs, "id", "text", salts=16).collect()}
    b = {r.id: r.y_pred for r in MD.nb_predict(m, docs, "id", "text", salts=1).collect()}
    assert a == b and len(a) == 500


def test_salted_join_equals_plain_join_with_hot_key(spark):
    from textlab.operators.joins import hot_keys, salted_join
    big = spark.range(9000).select(F.col("id").alias("rid"),
                                   F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"))
    small = spark.range(100).select(F.col("id").alias("pk"), (F.col("id") * 10).alias("v"))
    assert 7 in hot_keys(big, "k")
    got = sorted(tuple(r) for r in salted_join(big, small, "k", "pk", ["rid"]).select("rid", "v").collect())
    want = sorted(tuple(r) for r in big.join(small, big.k == small.pk).select("rid", "v").collect())
    assert got == want and len(got) == 9000


def test_nb_model_missing_a_class_never_predicts_it(spark):
    from textlab.operators import models as MD
    rows = [(1, "a b", 0), (1, "c d", 1), (2, "a a", 0), (2, "b", 0)]  # model 2 has no class 1
    df = spark.createDataFrame(rows, "m int, text string, label int")
    docs = spark.createDataFrame([(1, "zzz"), (2, "c d d"), (3, "")], "id int, text string")
    m = MD.nb_train(df, "text", "label", model_cols=["m"])
    got = MD.nb_predict(m, docs, "id", "text").where("m = 2").collect()
    assert {r.id: r.y_pred for r in got} == {1: 0, 2: 0, 3: 0}
    assert all(x == x for r in got for x in r.scores)  # no NaN


def test_reports_and_votes_invariant_to_partitioning(spark):
    from textlab.operators import prep as P
    base = spark.range(5000).select((F.col("id") % 37).alias("k"), (F.col("id") % 3).alias("y_true"),
                                    ((F.col("id") * 7) % 3).alias("y_pred"))
    outs = []
    for parts in (1, 5, 13):
        df = base.repartition(parts)
        rep = sorted(tuple(r) for r in M.classification_report(df, ["k"]).collect())
        votes = sorted((r.k, tuple(r.modes)) for r in P.vote_keep_ties(df, ["k"], "y_pred").collect())
        outs.append((rep, votes))
    assert outs[0] == outs[1] == outs[2]


def test_class_weights_fail_when_a_class_is_missing_from_train(spark):
    import pytest
    train = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    with pytest.raises(Exception, match="class missing from train"):
        M.class_weights(train, "label", classes).collect()
    w = {r.label: r.w for r in M.class_weights(train, "label", classes.where("label < 2")).collect()}
    assert w == {0: 3 / (2 * 2), 1: 3 / (2 * 1)}


def test_experiment_grid_custom_model_name(spark):
    from textlab.plans.q_zeroshot import q_experiment_grid
    rows = q_experiment_grid(spark, "/root/testdata/sf0.001", custom_model="my-model", custom_for="ROB-LRG").collect()
    assert len({(r.run_id, r.seed) for r in rows}) == len(rows) == 60
    assert all(("my-model" in r.run_id) == (r.model == "ROB-LRG") for r in rows)
    b = {(r.model, r.batch) for r in rows}
    assert ("DEB-V3", 2) in b and ("ROB-LRG", 4) in b


def test_weighted_rows_stay_in_their_tasks(spark):
    """Two classes are no two tasks: a class's rows are not put together to be weighted."""
    df = spark.range(0, 8000, 1, 8).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"),
                                           F.repeat(F.lit("some words "), 20).alias("text"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # of larger tables no size is known beforehand
    x = SM.weight_rows(df, M.class_weights(df, "label"), "label").persist()  # as the learner does
    try:
        tasks = {r["t"]: r["count"] for r in x.groupBy(F.spark_partition_id().alias("t")).count().collect()}
        assert sum(tasks.values()) == 8000 and max(tasks.values()) == 1000
        assert x.where("w != 1").count() == 0
    finally:
        x.unpersist()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
