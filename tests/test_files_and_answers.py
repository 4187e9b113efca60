"""File positions, pruned read-back, publishing, request ledger, scorers, learned vocabulary, classes from the data."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textlab.operators import features as FE
from textlab.operators import ledger as LG
from textlab.operators import prep as P
from textlab.operators.ranks import dense_index
from textlab.operators.zeroshot import scorer_predict
from textlab.session import scratch_dir
from textlab.sources import io as IO
from textlab.sources import published as PB


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- positions over many files -------------------------------------------------------------------------

def write_files(folder, parts):
    os.makedirs(folder)
    for k, lines in enumerate(parts):
        with open(os.path.join(folder, f"f{k}.txt"), "w") as f:
            f.write("".join(x + "\n" for x in lines))


def test_positions_over_files_that_split(spark, tmp_path):
    parts = [[f"a{k}" for k in range(30_000)], [f"b{k}" for k in range(7)], [], [f"d{k}" for k in range(50_000)], ["é", "", "x"]]
    folder = str(tmp_path / "x")
    write_files(folder, parts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df, n = IO.read_lines_at(spark, folder)
        assert n == sum(map(len, parts)) and df.rdd.getNumPartitions() > 8
        got = sorted((r["at"], r.file[-6:], r.pos, r.line) for r in df.collect())
        want = [(f"f{k}.txt", i, x) for k, p in enumerate(parts) for i, x in enumerate(p)]
        assert got == [(at, *w) for at, w in enumerate(want)]
        # the labelled reader drops blank lines and numbers what is left
        lab, n = IO.read_lines_at(spark, folder, labelled=True)
        assert n == len(want) - 1 and {r["at"]: r.line for r in lab.where("file like '%f4.txt'").collect()} == {
            n - 2: "é", n - 1: "x"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairing_of_files_cut_differently(spark, tmp_path):
    texts, labels = [f"t{k}" for k in range(10)], [str(k % 3) for k in range(10)]
    write_files(str(tmp_path / "x"), [texts[:4], texts[4:5], texts[5:]])
    write_files(str(tmp_path / "y"), [labels[:1], labels[1:8], labels[8:9], labels[9:]])
    x = IO.read_lines_at(spark, str(tmp_path / "x"))
    y = IO.with_file_positions(IO.read_labels(spark, str(tmp_path / "y")))
    got = sorted((r["at"], r.line, r.label) for r in IO.pair_files(x, y).collect())
    assert got == [(k, f"t{k}", k % 3) for k in range(10)]
    write_files(str(tmp_path / "z"), [labels[:9]])
    with pytest.raises(ValueError, match="differ in length"):
        IO.pair_files(x, IO.with_file_positions(IO.read_labels(spark, str(tmp_path / "z"))))


# --- pruned read-back ----------------------------------------------------------------------------------

def test_a_filter_on_the_seed_leaves_out_folders(spark):
    path = scratch_dir(spark, "preds")
    rows = [(i, i % 2, f"run {r}", s) for i in range(20) for r in "ab" for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, y_pred int, run_id string, seed int")
    IO.write_partitioned(df, path, ["run_id", "seed"], mode="overwrite", fmt="csv")
    back = IO.read_partitions(spark, path, "doc_id LONG, y_pred INT", "run_id STRING, seed INT")
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    one = back.where("seed = 2 and run_id = 'run a'")
    assert one.count() == 20 and "PartitionFilters: [isnotnull(seed" in plan_of(one).replace("run_id#", "").replace("\n", "")
    assert len(one.inputFiles()) >= 1 and all("seed=2" in f for f in {r.f for r in one.select(
        F.input_file_name().alias("f")).collect()})
    index = IO.file_index(spark, path, r"run_id=([^/]+)/seed=(\d+)/", {"run": 1, "seed": 2})
    some = IO.read_indexed(index.where("seed = '3'"), "doc_id LONG, y_pred INT")
    assert some.count() == 40 and {r.seed for r in some.collect()} == {"3"}
    assert all("seed=3" in f for f in some.inputFiles())
    assert IO.read_indexed(index.where("seed = '9'"), "doc_id LONG, y_pred INT").count() == 0


# --- publishing ----------------------------------------------------------------------------------------

SCHEMA = "x long, run_id string, seed int"


def test_readers_see_a_publish_whole_or_not_at_all(spark):
    root, cols = scratch_dir(spark, "pub"), ["run_id", "seed"]

    def rows(*triples):
        return spark.createDataFrame(list(triples), SCHEMA)

    def read(version=None):
        return sorted(map(str, map(tuple, PB.read(spark, root, SCHEMA, version).select("x", "run_id", "seed").collect())))

    assert read() == [] and PB.latest(spark, root) is None
    first = rows((1, "a/b c%", 1), (2, "a/b c%", 2), (3, None, 1))
    own = PB.stage(first, root, cols)
    assert read() == []  # staged, not committed
    assert PB.commit(spark, root, own, cols) == 0
    before = sorted(map(str, map(tuple, first.collect())))
    assert read() == before
    held = PB.read(spark, root, SCHEMA)  # a reader that began before the next publish
    second = PB.stage(rows((10, "a/b c%", 2), (11, "new", 1), (12, None, 1)), root, cols)
    assert read() == before
    assert PB.commit(spark, root, second, cols) == 1
    after = ["(1, 'a/b c%', 1)", "(10, 'a/b c%', 2)", "(11, 'new', 1)", "(12, None, 1)"]
    assert read() == sorted(after) and read(0) == before
    assert sorted(str((r.x, r.run_id, r.seed)) for r in held.collect()) == before
    with pytest.raises(Exception):  # another commit took this version
        spark.range(1).write.mode("error").parquet(f"{root}/manifest/version=1")
    assert PB.commit(spark, root, PB.stage(rows(), root, cols) if False else second, cols) == 2 and read() == sorted(after)


# --- request ledger ------------------------------------------------------------------------------------

def test_an_interrupted_run_repeats_no_answered_call(spark, tmp_path):
    log, fuse, ledger = str(tmp_path / "calls"), str(tmp_path / "fuse"), scratch_dir(spark, "ledger")
    df = spark.createDataFrame([(k, f"prompt {k % 40}") for k in range(60)] + [(99, None)], "id int, prompt string")

    def calls_of(path):  # workers cannot import this module, so what they run is defined here
        if not os.path.exists(path):
            return []
        with open(path) as f:
            return [x.split("\t") for x in f.read().splitlines()]

    def answer(prompts: pd.Series, attempt: int):
        if os.path.exists(fuse) and len(calls_of(log)) >= 15:
            os._exit(1)  # the worker is lost
        with open(log, "a") as f:
            f.writelines(f"{p}\t{attempt}\n" for p in prompts)
        return ["'a'" if int(p.split()[1]) % 4 or attempt > 1 else "what?" for p in prompts]

    open(fuse, "w").close()
    with pytest.raises(Exception):
        LG.settle(df, "prompt", answer, ["a", "b"], ledger, wave=10)
    answered = {(r.digest, r.attempt) for r in LG.read_ledger(spark, ledger).collect()}
    assert 0 < len(answered) < 40
    os.remove(fuse)
    before = len(calls_of(log))
    LG.settle(df, "prompt", answer, ["a", "b"], ledger, wave=10)
    later = calls_of(log)[before:]
    stored = {r.digest: r.valid for r in LG.read_ledger(spark, ledger).collect()}
    again = spark.createDataFrame(later, "prompt string, attempt string").select(LG.digest("prompt").alias("d"), F.col("attempt").cast("int"))
    asked = [(r.d, r.attempt) for r in again.collect()]
    assert len(set(asked)) == len(asked) and not set(asked) & answered and len(stored) == 40
    count = len(calls_of(log))
    LG.settle(df, "prompt", answer, ["a", "b"], ledger)  # nothing is left to ask
    assert len(calls_of(log)) == count
    out = {r.id: (r.y_pred, r.attempts) for r in LG.outcomes(df, "prompt", ["a", "b"], ledger).collect()}
    assert out == {**{k: (0, 1 if k % 40 % 4 else 2) for k in range(60)}, 99: (None, None)}


def test_ledger_keeps_failures_apart(spark):
    ledger = scratch_dir(spark, "ledger")
    df = spark.createDataFrame([(k, f"p{k}") for k in range(8)], "id int, prompt string").repartition(2)

    def answer(prompts, attempt):
        if (prompts == "p3").any():
            raise ValueError("refused")
        return ["a" if p != "p5" else "zzz" for p in prompts]

    LG.settle(df, "prompt", answer, ["a"], ledger, max_attempts=2)
    out = {r.id: (r.y_pred, r.attempts, r.error) for r in LG.outcomes(df, "prompt", ["a"], ledger).collect()}
    assert out[3][:2] == (None, 2) and "refused" in out[3][2] and out[5] == (None, 2, "unknown label")
    assert all(out[k] == (0, 1, None) for k in (0, 1, 2, 4, 6, 7))


# --- scorer --------------------------------------------------------------------------------------------

def test_failing_rows_stand_alone_whatever_the_batches(spark, tmp_path):
    path = str(tmp_path / f"model-{time.time_ns()}.txt")
    with open(path, "w") as f:
        f.write("x\n")

    def load_counter(path):
        """A scorer that says how often its file was opened in this worker."""
        with open(path + ".opened", "a") as f:
            f.write(f"{os.getpid()}\n")
        with open(path) as f:
            word = f.read().strip()

        def score(texts, labels):
            if (texts == "bad").any():
                raise RuntimeError("bad text")
            if (texts == "short").any():
                return [[1.0]] * len(texts)
            return pd.DataFrame({labels[0]: texts.str.count(word), labels[1]: [len(texts)] * len(texts)})

        return score

    rows = [(k, "bad" if k == 4 else "short" if k == 7 else None if k == 9 else "x" * k) for k in range(30)]
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "id int, text string").repartition(parts)
        out = scorer_predict(df, "text", ["x", "n"], load_counter, model=path, max_chars=5)
        got = {r.id: (r.scores and r.scores[0], r.error) for r in out.collect()}
        assert "bad text" in got[4][1] and "needed" in got[7][1] and got[9][1] is not None
        assert got[4][0] is got[7][0] is got[9][0] is None
        assert all(got[k] == (float(k), None) for k in range(30) if k not in (4, 7, 9))
        assert {r.id for r in out.where("y_pred is null").collect()} == {4, 7, 9}
    name = os.path.basename(path) + ".opened"
    from pyspark import SparkFiles
    with open(os.path.join(SparkFiles.getRootDirectory(), name)) as f:
        opened = f.read().split()
    assert len(opened) == len(set(opened))  # once in each worker


# --- classes, vocabulary -------------------------------------------------------------------------------

def test_dense_index_of_many_values_has_no_single_task(spark):
    df = spark.range(5000).select(F.format_string("k%05d", F.col("id") * 7 % 3001).alias("c")).unionByName(
        spark.createDataFrame([(None,), ("é",), ("",)], "c string"))
    out = dense_index(df.repartition(7), "c")
    assert "Window" not in plan_of(out) and "SinglePartition" not in plan_of(out)
    got = sorted((r.idx, r.c) for r in out.collect())
    assert got == list(enumerate(sorted({r.c for r in df.collect() if r.c is not None}))) and {r.k for r in out.collect()} == {3003}
    assert dense_index(df.limit(0), "c").count() == 0


def test_learned_vocabulary(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, "c d b"), (3, None), (4, "")], "id int, text string")
    vocab = FE.learn_vocabulary(df, "text", 3)
    first = FE.FIRST_TOKEN_ID + 1
    assert {(r.token, r.id, r.n) for r in vocab.collect()} == {("b", first, 3), ("c", first + 1, 2), ("a", first + 2, 1)}
    got = {r.id: list(r.ids) for r in FE.encode_learned(df, "id", "text", vocab, 5).collect()}
    unknown = FE.FIRST_TOKEN_ID
    assert got == {1: [1, first, first + 2, first, 2], 2: [1, first + 1, unknown, first, 2], 3: [1, 2, 0, 0, 0], 4: [1, 2, 0, 0, 0]}


@pytest.fixture(scope="module")
def fifth_language(spark, tmp_path_factory):
    """The smallest tables with documents in a language without a word list, and without any."""
    folder = str(tmp_path_factory.mktemp("five"))
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    lang = F.when(F.col("doc_id") % 7 == 0, "it").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang"))
    docs.withColumn("lang", lang).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("key", ["softmax", "label_inverse", "weighted_ce", "label_index", "one_hot"])
def test_classes_come_from_the_data(spark, fifth_language, key):
    import duckdb

    from textlab.plans import catalog
    from textlab.plans.oracle_check import compare
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{fifth_language}/documents.parquet/*.parquet')")
    res = compare(spark, con, key, catalog.queries()[key], catalog.oracle_sql()[key], fifth_language)
    assert res["status"] == "OK", res


def test_votes_by_cleaned_text(spark):
    from textlab.functions.text import normalise_ws
    rows = [("a  b", 1), ("a b", 1), ("a b", 0), ("a --- b", 1), ("c", 0), ("c", 1), (None, 1), ("d", None)]
    df = spark.createDataFrame(rows, "t string, v int")
    first = {r.t: r.label for r in P.vote_by_text(df, "t", "v", normalise_ws).collect()}
    assert first == {"a b": 1}
    later = sorted((r.t, r.label) for r in P.vote_by_text(df, "t", "v", normalise_ws, clean_first=False).collect())
    assert later == [("a b", 1), ("a b", 1)]  # two copies survive, the tied one went
