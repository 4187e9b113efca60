"""Golden tests: confusion cells of the shipped runs (FIXTURES.md F4/F5)
baselines (FIXTURES.md F3)."""

import pytest

from textlab.operators import metrics as M
from golden import B2, B3, F3, F4, F5, ORDER, SEEDS, SIZES, cell_rows, check


def test_seed_summaries_match_shipped_files(spark):
    rows = [r for key, per_seed in F4.items() for seed, c in zip(SEEDS, per_seed) for r in cell_rows(key, seed, c)]
    df = spark.createDataFrame(rows, "ds string, model string, seed int, y_true int, y_pred int")
    rep = M.classification_report(df, ["ds", "model", "seed"], digits=None)
    summ = {(r.ds, r.model, r.metric): (r.mean, r.std)
            for r in M.seeds_summary(rep, ["ds", "model"]).collect()}
    for key, expected in B2.items():
        for metric, (mean, std) in zip(ORDER, expected):
            got = summ[(key[0], key[1], metric)]
            assert abs(got[0] - mean) <= 5e-4 + 1e-9 and abs(got[1] - std) <= 5e-4 + 1e-9, (key, metric, got, mean, std)


def test_size_study_matches_shipped_files(spark):
    rows = [(ds, n, t, p) for ds, per_size in F5.items() for n, c in zip(SIZES, per_size)
            for (_, _, _, t, p) in cell_rows((ds, "x"), 0, c)]
    df = spark.createDataFrame(rows, "ds string, n_train int, y_true int, y_pred int")
    rep = {(r.ds, r.n_train): r for r in M.classification_report(df, ["ds", "n_train"], digits=None).collect()}
    for ds, per_size in B3.items():
        for n, expected in zip(SIZES, per_size):
            r = rep[(ds, n)]
            for metric, want in zip(ORDER, expected):
                assert abs(getattr(r, metric) - want) <= 5e-4 + 1e-9, (ds, n, metric, getattr(r, metric), want)


def test_majority_baseline_matches_shipped_logs(spark):
    rows = [(ds, c) for ds, (counts, _) in F3.items() for c, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "ds string, label int")
    rep = {r.ds: r for r in M.majority_baseline(df, "label", ["ds"], digits=None).collect()}
    for ds, (_, (acc, prec, rec, f1m, f1w)) in F3.items():
        r = rep[ds]
        for got, want in [(r.accuracy, acc), (r.precision, prec), (r.recall, rec), (r.f1_macro, f1m),
                          (r.f1_weighted, f1w)]:
            assert abs(got - want) < 1e-8, (ds, got, want)


def test_summary_text_format(spark):
    rows = [r for seed, c in zip(SEEDS, F4[("NYT", "ROB-LRG")]) for r in cell_rows(("NYT", "ROB-LRG"), seed, c)]
    df = spark.createDataFrame(rows, "ds string, model string, seed int, y_true int, y_pred int")
    rep = M.classification_report(df, ["ds", "model", "seed"], digits=None)
    lines = [r.line for r in M.seeds_summary_text(M.seeds_summary(rep, ["ds"]), ["ds"]).orderBy("line_no").collect()]
    assert lines == ["accuracy: 0.918 +/- 0.012", "precision: 0.922 +/- 0.011", "recall: 0.918 +/- 0.012",
                     "f1 score macro: 0.897 +/- 0.014", "f1 score weighted: 0.919 +/- 0.011"]


def test_metric_selector_spellings(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 0.5)], ORDER)
    assert df.select(M.select_metric(df, "f1_score_macro")).first()[0] == 0.4
    assert df.select(M.select_metric(df, "f1_macro")).first()[0] == 0.4
    # the reference's default spelling fell through to precision
    assert df.select(M.select_metric(df, "f1_macro", legacy_default=True)).first()[0] == 0.2
    with pytest.raises(ValueError):
        M.select_metric(df, "auc")


def test_best_epoch_later_tie_wins_and_null(spark):
    df = spark.createDataFrame([("r", 0, 0.5), ("r", 1, 0.7), ("r", 2, 0.7), ("r", 3, 0.6), ("s", 0, None)],
                               "run string, epoch int, score double")
    got = {(r.run, r.epoch): r.is_best for r in M.best_so_far(df, ["run"], "epoch", "score").collect()}
    assert got == {("r", 0): True, ("r", 1): True, ("r", 2): True, ("r", 3): False, ("s", 0): False}


def test_log_attempts_keeps_last(spark):
    epochs = [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]  # FIXTURES.md F6
    df = spark.createDataFrame([("f", i, e) for i, e in enumerate(epochs)], "file string, line int, epoch int")
    out = M.log_attempts(df, ["file"], "line", "epoch").where("is_last").orderBy("line").collect()
    assert [r.epoch for r in out] == list(range(10)) and {r.attempt for r in out} == {2}


def test_golden_check_counts_every_cell(spark):
    matched, total = check(spark)
    assert matched == total == 21 * 10 + 20 * 5 + 4 * 5
