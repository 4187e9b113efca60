"""An epoch-wise linear text classifier whose training is a log.

Softmax regression on hashed token shares, fitted by full-batch gradient
steps.  A step is one aggregation: every row's class probabilities under the
current weights, its gradient by feature, summed map-side and then by
feature; what comes back to the driver are (features + 1) x classes numbers,
a bound that two parameters set and ``fit`` checks.  Rows are read from a
stored feature table, so an epoch reads neither texts nor tokens.

After each epoch the probabilities of the train and the validation rows are
stored (``probabilities/epoch=k``), the weights become a version in the model
store, and loss and metrics of both parts are computed from what was stored:
``log`` is a table that later readers (model choice, reports) share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.arrays import argmax, softmax
from textlab.functions.random import draw
from textlab.functions.text import tokens, with_runs
from textlab.operators import metrics as M
from textlab.operators import model_store as MS

#: Weights that the driver and every task hold; they travel in the plan.
MAX_WEIGHTS = 1 << 18


def with_features(df: DataFrame, text: str, dims: int, out: str = "feats") -> DataFrame:
    """Adds ``out``: array of (f, x): the bias (0, 1), then every hashed token feature 1..dims with its share of the
    text's tokens, times ``dims``.  NULL and empty texts have the bias alone."""
    ids = F.transform(tokens(text), lambda t: (draw(F.lit("0"), t) % dims + 1).cast("int"))
    x = with_runs(df, F.coalesce(ids, F.array().cast("array<int>")), "_runs")
    x = x.withColumn("_total", F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]))
    share = F.transform("_runs", lambda r: F.struct(r["value"].alias("f"), (r["n"] * F.lit(float(dims)) / F.col("_total")).alias("x")))
    bias = F.array(F.struct(F.lit(0).alias("f"), F.lit(1.0).alias("x")))
    return x.withColumn(out, F.concat(bias, share)).drop("_runs", "_total")


def _weights(w: list[float]) -> Column:
    """The weights as one constant array (a text that Catalyst folds, exact to the last digit)."""
    return F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")


def probabilities(feats: DataFrame, w: list[float], classes: int, col: str = "feats") -> DataFrame:
    """``feats`` with ``p``, the class probabilities; weights by class, then feature."""
    width, weights = len(w) // classes, _weights(w)

    def logit(c: Column) -> Column:
        return F.aggregate(col, F.lit(0.0), lambda a, f: a + f["x"] * F.get(weights, c * width + f["f"]))

    z = feats.withColumn("_z", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), logit))
    return z.withColumn("p", softmax(F.col("_z"))).drop("_z")


def gradient(rows: DataFrame, w: list[float], classes: int, n: int) -> list[float]:
    """Mean gradient of the weighted cross-entropy over ``n`` rows (y, weight, feats)."""
    p = probabilities(rows, w, classes).select("y", "weight", "p", F.explode("feats").alias("f"))

    def term(c: int) -> Column:
        return F.sum(F.col("weight") * (F.get("p", F.lit(c)) - (F.col("y") == c).cast("double")) * F.col("f.x"))

    width = len(w) // classes
    out = [0.0] * len(w)
    for r in p.groupBy(F.col("f.f").alias("f")).agg(*[term(c).alias(f"g{c}") for c in range(classes)]).collect():
        for c in range(classes):  # width rows at most
            out[c * width + r.f] = r[f"g{c}"] / n
    return out


@dataclass
class Fit:
    """What a training left in its folder."""

    run_id: str
    seed: int
    folder: str
    classes: int
    dims: int
    epochs: int

    def stored(self, spark: SparkSession) -> DataFrame:
        """(key, part, y, weight, p, epoch) of every row and epoch."""
        return spark.read.parquet(f"{self.folder}/probabilities")

    def log(self, spark: SparkSession, digits: int | None = 6) -> DataFrame:
        """(run_id, seed, part, epoch, n, loss, the five metrics), from the stored probabilities."""
        own = self.stored(spark).withColumn("y_pred", argmax(F.col("p")))
        report = M.classification_report(own, ["part", "epoch"], "y", "y_pred", digits)
        loss = own.groupBy("part", "epoch").agg(F.avg(cross_entropy()).alias("loss"))
        if digits is not None:
            loss = loss.withColumn("loss", F.round("loss", digits))
        return report.join(loss, ["part", "epoch"]).select(
            F.lit(self.run_id).alias("run_id"), F.lit(self.seed).cast("long").alias("seed"), "part", "epoch", "n", "loss",
            *M.METRICS)


def cross_entropy(eps: float = 1e-12) -> Column:
    """A stored row's weighted loss; its average is over rows, not weights."""
    return -F.col("weight") * F.ln(F.greatest(F.get("p", F.col("y")), F.lit(eps)))


def fit(rows: DataFrame, key: str, folder: str, run_id: str, seed: int, dims: int, epochs: int = 10, steps: int = 1,
        rate: float = 0.05, metric: str = "f1_score_macro") -> Fit:
    """Train on the rows (``key``, part, label, feats) whose part is ``train``; ``folder`` is new and shared.

    Classes are those of both parts in order; balanced class weights come from the train part, which must have
    every class.  The validation ``metric`` of an epoch decides ``best`` (without validation rows there is none).
    """
    spark = rows.sparkSession
    counts = {}
    for r in rows.where(F.col("label").isNotNull()).groupBy("label", "part").count().collect():  # a row a class and part
        counts.setdefault(r.label, {})[r.part] = r["count"]
    labels = sorted(counts)
    k, width = len(labels), dims + 1
    if k * width > MAX_WEIGHTS:
        raise ValueError(f"{k} classes x {width} features are more than {MAX_WEIGHTS} weights")
    absent = [c for c in labels if not counts[c].get("train")]
    if absent:
        raise ValueError(f"classes missing from train: {absent}")
    n = sum(c["train"] for c in counts.values())
    has_val = any(len(c) > 1 for c in counts.values())
    index = spark.createDataFrame([(c, j, n / (k * counts[c]["train"])) for j, c in enumerate(labels)],
                                  rows.select("label", F.lit(0).alias("y"), F.lit(0.0).alias("weight")).schema)
    rows.join(index, "label").select(key, "part", "y", "weight", "feats").write.parquet(f"{folder}/features")
    feats = spark.read.parquet(f"{folder}/features")
    train, w = feats.where("part = 'train'"), [0.0] * (k * width)
    out = Fit(run_id, seed, folder, k, dims, epochs)
    for epoch in range(epochs):
        for _ in range(steps):
            w = [a - rate * g for a, g in zip(w, gradient(train, w, k, n))]
        probabilities(feats, w, k).select(key, "part", "y", "weight", "p").write.parquet(f"{folder}/probabilities/epoch={epoch}")
        score = None
        if has_val:
            val = spark.read.parquet(f"{folder}/probabilities/epoch={epoch}").where("part = 'val'")
            report = M.classification_report(val.withColumn("y_pred", argmax(F.col("p"))), [], "y", "y_pred", None)
            score = report.select(M.select_metric(report, metric)).first()[0]
        state = spark.createDataFrame([(c, w[j * width:(j + 1) * width]) for j, c in enumerate(labels)],
                                      rows.select("label", F.array(F.lit(0.0)).alias("w")).schema).coalesce(1)
        MS.save(f"{folder}/models", run_id, seed, {"weights": state}, epoch, score, {"kind": "linear", "dims": dims})
    return out


def load(spark: SparkSession, folder: str, run_id: str, seed: int, which: str | int = "last") -> tuple[list, list[float], int]:
    """(labels, weights, dims) of a stored version."""
    s = MS.resolve(spark, f"{folder}/models", run_id, seed, which)
    state = s.tables["weights"].orderBy("label").collect()
    return [r.label for r in state], [x for r in state for x in r.w], s.params["dims"]


def predict(model: tuple[list, list[float], int], docs: DataFrame, text: str, out: str = "y_pred") -> DataFrame:
    """``docs`` with ``p`` and the most likely label."""
    labels, w, dims = model
    x = probabilities(with_features(docs, text, dims, "feats"), w, len(labels)).drop("feats")
    return x.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in labels]), argmax(F.col("p")) + 1))
