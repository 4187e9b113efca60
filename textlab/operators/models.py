"""Classifiers re-aimed for Spark.

(a) Multinomial naive Bayes as pure relational aggregation: training is
    token counts per (model, class, token) with map-side partial
    aggregation; scoring is a join of the documents' tokens with the
    vocabulary table plus a per-document sum.  ``model_cols`` lets many
    models (e.g. one per training size or seed) train and score in the same
    jobs: the grid is data, not a driver loop.
(b) A Spark ML pipeline (tokenizer, hashing TF, IDF, weighted logistic
    regression) for an iterative learner; fits happen once per model on
    cached features.

The sub-word transformer fine-tuning of the reference is not data work and
is not rebuilt (see README).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.arrays import argmax
from textlab.functions.text import TOKEN_SPLIT, tokens, with_token_runs
from textlab.operators.joins import hot_values, salted_join
from textlab.session import cut_lineage


#: (class, token) pairs up to which a model is broadcast to the scored texts; beyond it both sides are exchanged by token.
BROADCAST_PAIRS = 300_000


@dataclass
class NBModel:
    model_cols: list[str]    # columns identifying one model
    token_table: DataFrame   # model..., label, token, n, logp, log_default (observed pairs)
    class_table: DataFrame   # model..., label, n_docs, total, V, log_prior, log_default: a row per model and class
    counts: DataFrame        # model..., label, token, n; token NULL counts documents: all that a model is made of
    alpha: float = 1.0

    @cached_property
    def pairs(self) -> int:
        return self.counts.count()


def nb_counts(df: DataFrame, text: str, label: str, model_cols: list[str] = ()) -> DataFrame:
    """(model, class, token, n): the sufficient statistics of naive Bayes, in one pass over the texts.

    Each document emits its tokens plus one NULL marker (summed map-side), so the table also carries the
    document counts.  Counts of several tables may be added up.  Rows without a label teach nothing.
    """
    mc = list(model_cols)
    base = df.select(*mc, F.col(label).alias("label"), text).where(F.col("label").isNotNull())
    marker_and_tokens = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(tokens(text), F.array().cast("array<string>")))
    return (base.select(*mc, "label", F.explode(marker_and_tokens).alias("token"))
            .groupBy(*mc, "label", "token").agg(F.count(F.lit(1)).alias("n")))


def nb_counts_of_uses(df: DataFrame, text: str, uses: str, model_cols: list[str]) -> DataFrame:
    """``nb_counts`` of many models whose training sets share texts: a row's ``uses`` is an array of
    (model..., label, m), m times in that model's training set.  A text is read and split once, whatever its uses."""
    mc = list(model_cols)
    marker_and_tokens = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(tokens(text), F.array().cast("array<string>")))
    return (df.select(uses, F.explode(marker_and_tokens).alias("token")).select("token", F.inline(uses))
            .groupBy(*mc, "label", "token").agg(F.sum("m").alias("n")))


def nb_from_counts(tc: DataFrame, model_cols: list[str] = (), alpha: float = 1.0) -> NBModel:
    """The models whose counts a stored table holds: log p(t|c) = ln((n_tc + alpha) / (N_c + alpha * |V|)),
    V = model vocabulary.  ``tc`` is read several times, so it should be a stored table."""
    mc = list(model_cols)
    is_doc = F.col("token").isNull()
    classes = tc.groupBy(*mc, "label").agg(
        F.sum(F.when(is_doc, F.col("n")).otherwise(0)).alias("n_docs"),
        F.sum(F.when(is_doc, 0).otherwise(F.col("n"))).alias("total"))
    size = tc.groupBy(*mc, "token").agg(F.lit(1).alias("one")).groupBy(*mc).agg(F.count("token").alias("V"))
    # a single model's vocabulary size is one number
    classes = classes.join(size, mc) if mc else classes.withColumn("V", size.select("V").scalar())
    of_model = Window.partitionBy(*mc) if mc else Window.partitionBy(F.lit(0))  # a row per class
    denom = F.col("total") + F.lit(float(alpha)) * F.col("V")
    classes = classes.select(
        *mc, "label", "n_docs", "total", "V", F.ln(F.col("n_docs") / F.sum("n_docs").over(of_model)).alias("log_prior"),
        F.when(denom > 0, F.ln(F.lit(float(alpha)) / denom)).otherwise(F.lit(float("-inf"))).alias("log_default"))
    tok = tc.where(~is_doc).join(classes, [*mc, "label"]).select(
        *mc, "label", "token", "n", F.ln((F.col("n") + F.lit(float(alpha))) / denom).alias("logp"), "log_default")
    return NBModel(mc, tok, classes, tc, alpha)


def nb_train(df: DataFrame, text: str, label: str, model_cols: list[str] = (), alpha: float = 1.0) -> NBModel:
    """Multinomial NB with Laplace/Lidstone smoothing ``alpha``.  The count table is the model; it is
    checkpointed to the shared checkpoint dir (computed once, lineage cut)."""
    return nb_from_counts(cut_lineage(nb_counts(df, text, label, model_cols)), model_cols, alpha)


def nb_predict(model: NBModel, docs: DataFrame, key: str, text: str, out: str = "y_pred", salts: int = 32,
               broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Arg-max class per (model, document); ties -> first class in order.

    score_c = log_prior_c + N_d * log_default_c + sum_t n_dt (logp_tc - log_default_c),
    N_d = the document's in-vocabulary token count; only observed (class,
    token) pairs are stored, unobserved ones contribute the default.

    A model of at most ``broadcast_pairs`` counted pairs is broadcast, and the texts are not moved at all: their
    tokens meet it where they are.  For a larger one a text's tokens are counted inside its row (sorted, run
    lengths), so that one row a document and distinct token is exchanged by token; tokens that are hot in the
    model are salted, others left to Spark's skew join.  Either way one more exchange, of sums, brings a
    document's classes together; documents without known tokens come through as rows without a match.
    ``scores`` is in class order over all models' classes; a class that a model has not seen scores -inf and can
    never win.
    """
    mc = model.model_cols
    cells = model.class_table.select(*mc, "label", "log_prior", "log_default").limit(WIDE + 1).collect() if not mc else []
    wide = bool(cells) and len(cells) <= WIDE
    vocab = _wide_vocabulary(model, cells) if wide else _long_vocabulary(model)
    if model.pairs <= broadcast_pairs:
        each = docs.select(key, F.explode_outer(tokens(text)).alias("token"), F.lit(1).alias("n"))
        hits = each.join(F.broadcast(vocab), F.col("token") == F.col("_token"), "left")
    else:
        each = with_token_runs(docs.select(key, text), text, "_runs").select(key, F.explode_outer("_runs").alias("_run"))
        each = each.select(key, "_run.token", "_run.n")
        by_token = model.token_table.groupBy("token").agg(F.sum("n").alias("n"))
        hits = salted_join(each, vocab, "token", "_token", [key], "left", salts, hot=hot_values(by_token, "token", "n"))
    if wide:
        return _wide_scores(hits, sorted(cells, key=lambda r: r.label), key, out)
    label_type = model.token_table.schema["label"].dataType
    sums = (hits.select(key, "n", F.inline_outer("entries"))
            .groupBy(key, "model", "label").agg(F.sum(F.col("n") * F.col("d")).alias("s"))
            .groupBy(key).agg(F.collect_list(F.struct("model", "label", "s")).alias("sums")))
    per_model = model.class_table.groupBy(_model_struct(mc)).agg(
        F.sort_array(F.collect_list(F.struct("label", "log_prior", "log_default"))).alias("own"))
    models = per_model.agg(F.collect_list(F.struct("model", "own")).alias("models"),
                           F.sort_array(F.array_distinct(F.flatten(F.collect_list("own.label")))).alias("labels"))
    every = models.select(F.struct("models", "labels").alias("every")).scalar()  # one row: a scalar subquery, no join
    x = sums.select(key, "sums", every.alias("_every")).select(key, "sums", "_every.labels", F.inline("_every.models"))

    def found(label: Column) -> Column:
        hit = F.filter("sums", lambda e: (e["model"] == F.col("model")) & e["label"].eqNullSafe(label))
        return F.coalesce(F.get(hit, F.lit(0))["s"], F.lit(0.0))

    def score(label: Column) -> Column:
        own = F.get(F.filter("own", lambda c: c["label"] == label), F.lit(0))
        s = own["log_prior"] + F.col("_nd") * own["log_default"] + found(label)
        return F.coalesce(s, F.lit(float("-inf")))

    x = x.withColumn("_nd", found(F.lit(None).cast(label_type)))
    x = x.withColumn("scores", F.transform("labels", score))
    return x.select(*[F.col(f"model.{c}").alias(c) for c in mc], key, "scores",
                    F.element_at("labels", argmax(F.col("scores")) + 1).alias(out))


#: Classes of a single model up to which a token carries one number per class, in columns.
WIDE = 12


def _model_struct(mc: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in mc], F.lit(0).alias("_m")).alias("model")


def _long_vocabulary(model: NBModel) -> DataFrame:
    """(_token, entries): for each model and class, and for each model one without a class that counts the token."""
    label_type = model.token_table.schema["label"].dataType
    own = F.collect_list(F.struct(_model_struct(model.model_cols), "label", (F.col("logp") - F.col("log_default")).alias("d")))
    vocab = model.token_table.groupBy(F.col("token").alias("_token")).agg(own.alias("own"))
    counting = F.transform(F.array_distinct(F.col("own.model")), lambda m: F.struct(
        m.alias("model"), F.lit(None).cast(label_type).alias("label"), F.lit(1.0).alias("d")))
    return vocab.select("_token", F.concat("own", counting).alias("entries"))


def _wide_vocabulary(model: NBModel, cells: list) -> DataFrame:
    """(_token, d0, d1, ...): what one occurrence adds to each class of a single model, in order of label."""
    d = F.col("logp") - F.col("log_default")
    return model.token_table.groupBy(F.col("token").alias("_token")).agg(*[
        F.coalesce(F.max(F.when(F.col("label") == F.lit(c.label), d)), F.lit(0.0)).alias(f"d{k}")
        for k, c in enumerate(sorted(cells, key=lambda r: r.label))])


def _wide_scores(hits: DataFrame, cells: list, key: str, out: str) -> DataFrame:
    """Scores of a single model's few classes: as many sums, in one exchange."""
    n = F.sum(F.when(F.col("_token").isNotNull(), F.col("n")).otherwise(0))
    sums = hits.groupBy(key).agg(n.alias("_nd"), *[
        F.coalesce(F.sum(F.col("n") * F.col(f"d{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(len(cells))])
    scores = F.array(*[F.lit(c.log_prior) + F.col("_nd") * F.lit(c.log_default) + F.col(f"s{k}") for k, c in enumerate(cells)])
    labels = F.array(*[F.lit(c.label) for c in cells])
    return sums.select(key, scores.alias("scores")).withColumn(out, F.element_at(labels, argmax(F.col("scores")) + 1))


def lr_estimator(text: str = "text", label: str = "label", weight: str | None = "w",
                num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.0) -> Pipeline:
    """Tokenizer -> hashing TF -> IDF -> (weighted) logistic regression."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_SPLIT, toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg,
                            predictionCol="prediction", probabilityCol="probability", rawPredictionCol="_raw")
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[tok, tf, idf, lr])


def lr_fit(train: DataFrame, text: str = "text", label: str = "label", weight: str | None = "w",
           **kw) -> PipelineModel:
    """Fit on cached input (the learner makes many passes).  Each task of a pass sends a gradient of all features,
    so there are a few tasks a core, however many files are read."""
    data = train.select(text, F.col(label).cast("double").alias(label), *([weight] if weight else []))
    data = data.coalesce(4 * train.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return lr_estimator(text, label, weight, **kw).fit(data)
    finally:
        data.unpersist()


def lr_predict(model: PipelineModel, docs: DataFrame, key: str, out: str = "y_pred") -> DataFrame:
    return model.transform(docs).select(key, F.col("prediction").cast("int").alias(out))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
