"""Classification / regression metrics as grouped aggregations.

Plan shape: the only step that touches every row is the confusion-cell
count ``groupBy(group, y_true, y_pred).count()`` (partial aggregation
map-side, so hot groups never reach one task un-aggregated).  Everything
after that runs on at most k^2 rows per group.

Semantics (the reference's): label set = classes in truth U prediction;
0/0 -> 0; weighted averages use the true support; macro F1 is the plain
mean over the label set; recall (weighted) equals accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.windows import running_agg

# --- fixed values: metric names and the reference's bundle order ---
METRICS = ["precision", "f1_weighted", "f1_macro", "accuracy", "recall"]
# Names of the five-line summary, in the order they are written.
SUMMARY_LINES = [("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"),
                 ("f1 score macro", "f1_macro"), ("f1 score weighted", "f1_weighted")]
# Accepted spellings of the validation metric selector.
METRIC_ALIASES = {"f1_score_macro": "f1_macro", "f1_macro": "f1_macro",
                  "f1_score_weighted": "f1_weighted", "f1_weighted": "f1_weighted",
                  "accuracy": "accuracy", "recall": "recall", "precision": "precision"}


def ratio(a, b) -> Column:
    """a / b as double with 0 where b == 0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def round_sig(x, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (sums of large values differ in
    the last bits between summation orders; this makes them comparable)."""
    x = F.col(x) if isinstance(x, str) else x
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / e, digits - 1) * e)


def confusion_cells(df: DataFrame, group_cols: list[str], y_true: str = "y_true",
                    y_pred: str = "y_pred") -> DataFrame:
    """(group..., y_true, y_pred, n): the one distributed step of every report."""
    t_type = df.schema[y_true].dataType
    return (df.groupBy(*group_cols, F.col(y_true).alias("y_true"),
                       F.col(y_pred).cast(t_type).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(cells: DataFrame, group_cols: list[str]) -> DataFrame:
    """support / predicted / tp per (group, label) over truth U prediction.

    Each cell contributes once to its true class and once to its predicted
    class, so a single aggregation replaces a join of two count tables.
    """
    zero = F.lit(0).cast("bigint")
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")),
    ))
    return (cells.select(*group_cols, sides.alias("s"))
            .groupBy(*group_cols, F.col("s.label").alias("label"))
            .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
                 F.sum("s.tp").alias("tp")))


def confusion_ovr(cells: DataFrame, group_cols: list[str]) -> DataFrame:
    """One-vs-rest 2x2 per class: tp, fp, fn, tn (group total by a window
    over the k per-class rows of each group, no join)."""
    pc = per_class(cells, group_cols)
    total = F.sum("support").over(Window.partitionBy(*group_cols))
    return pc.select(
        *group_cols, "label",
        F.col("tp").cast("bigint").alias("tp"),
        (F.col("predicted") - F.col("tp")).cast("bigint").alias("fp"),
        (F.col("support") - F.col("tp")).cast("bigint").alias("fn"),
        (total - F.col("support") - F.col("predicted") + F.col("tp")).cast("bigint").alias("tn"))


def report_from_cells(cells: DataFrame, group_cols: list[str], digits: int | None = 6) -> DataFrame:
    """n + the five metrics per group from confusion cells."""
    pc = per_class(cells, group_cols).select(
        *group_cols, "support", "tp",
        ratio(F.col("tp"), F.col("predicted")).alias("p"),
        ratio(F.col("tp"), F.col("support")).alias("r"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))
    n = F.sum("support")
    rep = pc.groupBy(*group_cols).agg(
        n.cast("bigint").alias("n"),
        ratio(F.sum("tp"), n).alias("accuracy"),
        ratio(F.sum(F.col("support") * F.col("p")), n).alias("precision"),
        ratio(F.sum(F.col("support") * F.col("r")), n).alias("recall"),
        F.avg("f1").alias("f1_macro"),
        ratio(F.sum(F.col("support") * F.col("f1")), n).alias("f1_weighted"))
    if digits is not None:
        rep = rep.select(*group_cols, "n", *[F.round(m, digits).alias(m) for m in METRICS])
    return rep


def classification_report(df: DataFrame, group_cols: list[str], y_true: str = "y_true",
                          y_pred: str = "y_pred", digits: int | None = 6) -> DataFrame:
    """Accuracy, weighted precision/recall/F1 and macro F1 for every group at once."""
    return report_from_cells(confusion_cells(df, group_cols, y_true, y_pred), group_cols, digits)


def majority_baseline(df: DataFrame, label: str, group_cols: list[str] = (),
                      digits: int | None = 6) -> DataFrame:
    """Predict the most frequent class for every row (tie -> smallest label).

    The prediction is constant per group, so the confusion cells are just
    the class counts relabelled: no second pass over the rows and no join
    (the majority comes from a window over the k class counts).
    """
    group_cols = list(group_cols)
    counts = df.groupBy(*group_cols, F.col(label).alias("y_true")).agg(F.count(F.lit(1)).alias("n"))
    w = (Window.partitionBy(*group_cols).orderBy(F.col("n").desc(), F.col("y_true"))
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over k class rows
    cells = counts.withColumn("majority", F.first("y_true").over(w)).withColumn("y_pred", F.col("majority"))
    # the majority is constant within a group, so grouping by it keeps one row per group
    return report_from_cells(cells, [*group_cols, "majority"], digits)


def metrics_long(report: DataFrame, group_cols: list[str]) -> DataFrame:
    """Unpivot the five metric columns to (group..., metric, value)."""
    return report.unpivot(group_cols, METRICS, "metric", "value")


def seeds_summary(report: DataFrame, group_cols: list[str], digits: int = 3) -> DataFrame:
    """Mean and population std of each metric over seeds, half-even rounded."""
    long = metrics_long(report, group_cols)
    return long.groupBy(*group_cols, "metric").agg(
        F.bround(F.avg("value"), digits).alias("mean"),
        F.bround(F.stddev_pop("value"), digits).alias("std"),
        F.count(F.lit(1)).cast("bigint").alias("n_seeds"))


def seeds_summary_text(summary: DataFrame, group_cols: list[str]) -> DataFrame:
    """'name: mean +/- std' lines with their line number (0..4)."""
    names = F.create_map(*[x for name, key in SUMMARY_LINES for x in (F.lit(key), F.lit(name))])
    order = F.create_map(*[x for i, (_, key) in enumerate(SUMMARY_LINES) for x in (F.lit(key), F.lit(i))])
    return summary.select(
        *group_cols,
        order[F.col("metric")].alias("line_no"),
        F.concat(names[F.col("metric")], F.lit(": "), F.col("mean").cast("string"),
                 F.lit(" +/- "), F.col("std").cast("string")).alias("line"))


def select_metric(report: DataFrame, name: str, legacy_default: bool = False) -> Column:
    """Column holding the validation metric ``name``.

    The reference's default name ``f1_macro`` silently fell through to
    precision; ``legacy_default=True`` reproduces that, otherwise both
    spellings are accepted and unknown names are rejected.
    """
    if legacy_default:
        legacy = {"f1_score_macro": "f1_macro", "f1_score_weighted": "f1_weighted",
                  "accuracy": "accuracy", "recall": "recall"}
        return F.col(legacy.get(name, "precision"))
    if name not in METRIC_ALIASES:
        raise ValueError(f"unknown validation metric {name!r}; use one of {sorted(METRIC_ALIASES)}")
    return F.col(METRIC_ALIASES[name])


def best_so_far(df: DataFrame, part_cols: list[str], order_col: str, score_col: str) -> DataFrame:
    """Best-checkpoint flag: score >= best of the earlier epochs (a later tie
    wins).  With the inclusive running max m, that is exactly score == m.
    NULL score (no validation part) gives is_best false.  Skew-safe running
    max, so one very long log is not one task."""
    r = running_agg(df, part_cols, order_col, score_col, "max", out="best_score")
    s = F.col(score_col)
    return r.withColumn("is_best", F.when(s.isNull(), F.lit(False)).otherwise(s == F.col("best_score")))


def log_attempts(df: DataFrame, part_cols: list[str], order_col: str, epoch_col: str) -> DataFrame:
    """Segment an append-only log: a new attempt starts at each epoch 0.

    attempt = running count of epoch-0 rows (skew-safe running sum, so one
    huge log / hot key is not one task); is_last = attempt equals the log's
    total number of attempts.
    """
    starts = F.when(F.col(epoch_col) == 0, 1).otherwise(0).cast("bigint")
    a = running_agg(df, part_cols, order_col, starts, "sum", out="attempt", total="_n_attempts")
    return a.withColumn("attempt", F.col("attempt").cast("bigint")) \
            .withColumn("is_last", F.col("attempt") == F.col("_n_attempts")).drop("_n_attempts")


def regression_report(df: DataFrame, y: str, yhat: str, group_cols: list[str] = (),
                      digits: int | None = 9) -> DataFrame:
    """MSE, RMSE, MAE, R^2 in one aggregation pass (``digits`` significant)."""
    e = F.col(y) - F.col(yhat)
    rep = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    rep = rep.select(*group_cols, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                     (F.lit(1.0) - ratio(F.col("_sse"), F.col("_sst"))).alias("r2"))
    if digits is not None:
        rep = rep.select(*group_cols, "n", *[round_sig(c, digits).alias(c) for c in ["mse", "rmse", "mae", "r2"]])
    return rep


def label_distribution(df: DataFrame, label: str, group_cols: list[str] = ()) -> DataFrame:
    """Count per class plus the max and min class count of the group."""
    counts = df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy(*group_cols)  # over <= k rows per group
    return counts.select("*", F.max("n").over(w).alias("max_n"), F.min("n").over(w).alias("min_n"))


def class_weights(train: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """Balanced weights w_c = n_train / (k * n_c); k from ``classes``.

    ``classes`` is the label column of train U val; every class must occur
    in train, else the query fails (the reference raised as well).
    """
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    # classes default to train's own: no second scan, no join
    j = counts if classes is None else classes.select(label).distinct().join(counts, label, "left")
    w = Window.partitionBy()  # k rows
    k = F.count(F.lit(1)).over(w)
    total = F.sum("n").over(w)
    return j.select(
        label,
        F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("class missing from train: "),
                                                           F.col(label).cast("string"))))
        .otherwise(F.col("n")).cast("bigint").alias("n"),
        (total.cast("double") / (k * F.col("n"))).alias("w"))
