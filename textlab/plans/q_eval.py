"""Evaluation queries: zero-shot scorer, reports, summaries, epoch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.random import draw
from textlab.operators import linear as LN
from textlab.operators import metrics as M
from textlab.operators import sampling as SM
from textlab.operators.joins import salted_join
from textlab.operators.zeroshot import LEXICON, LEXICON_LABELS, lexicon_predict
from textlab.plans import sqlfrag as S
from textlab.plans.q_sampling import CORPUS_SQL, SEED, TRAIN_FRAC, corpus_ids
from textlab.plans.registry import query, table, text_table
from textlab.session import scratch_dir

# --- fixed values: seeds and run tasks of the evaluation fixtures ---
SEEDS = [1234, 3456, 5678]
RUN_TASKS = ["quality", "toxic"]
FLIP_PCT = 2  # a prediction is flipped when draw % 10 < FLIP_PCT


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """labels x tasks x seeds with a seeded 20% prediction flip: (run_id, seed, doc_id, y_true, y_pred)."""
    lab = table(spark, sf, "labels")
    long = lab.select("doc_id", F.explode(F.array(
        *[F.struct(F.lit(t).alias("run_id"), F.col(t).cast("int").alias("y_true")) for t in RUN_TASKS])).alias("r"))
    s = long.select("doc_id", "r.run_id", "r.y_true",
                    F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed"))
    flip = (draw(F.col("seed"), F.col("run_id"), F.col("doc_id")) % 10) < FLIP_PCT
    return s.withColumn("y_pred", F.when(flip, 1 - F.col("y_true")).otherwise(F.col("y_true")))


RUNS_SQL = f"""runs as (
  select doc_id, run_id, y_true, seed,
    case when {S.draw('seed', 'run_id', 'doc_id')} % 10 < {FLIP_PCT} then 1 - y_true else y_true end y_pred
  from (select doc_id, 'quality' run_id, cast(quality as int) y_true from labels
        union all select doc_id, 'toxic', cast(toxic as int) from labels) l,
       (values {', '.join(f'({s})' for s in SEEDS)}) s(seed))"""

RUN_CELLS_SQL = "cells as (select run_id, seed, y_true, y_pred, count(*) n from runs group by all)"


def pred_lang(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon_predict(text_table(spark, sf, "documents", ["doc_id", "text", "lang"]), "text")


PRED_LANG_SQL = f"""tok as (
  select doc_id, unnest({S.tokens('text')}) token from documents),
hits as (
  select t.doc_id, lex.idx, count(*) c from tok t join {S.lexicon_values(LEXICON, LEXICON_LABELS)} using (token)
  group by all),
best as (select doc_id, first(idx order by c desc, idx) idx from hits group by doc_id),
pred as (
  select d.doc_id, d.lang, {S.label_list(LEXICON_LABELS)}[coalesce(b.idx, 0) + 1] y_pred
  from documents d left join best b using (doc_id))"""


@query("zero_shot_predict", f"with {PRED_LANG_SQL} select doc_id, y_pred from pred")
def q_zero_shot_predict(spark, sf):
    return pred_lang(spark, sf).select("doc_id", "y_pred")


@query("zero_shot_report", f"""with {PRED_LANG_SQL},
cells as (select lang y_true, y_pred, count(*) n from pred group by all)
select * from {S.report('cells', [])}""")
def q_zero_shot_report(spark, sf):
    return M.classification_report(pred_lang(spark, sf), [], "lang", "y_pred")


@query("classification_report", f"""with {RUNS_SQL}, {RUN_CELLS_SQL}
select * from {S.report('cells', ['run_id', 'seed'])}""")
def q_classification_report(spark, sf):
    return M.classification_report(runs(spark, sf), ["run_id", "seed"])


@query("confusion_ovr", f"""with {RUNS_SQL}, {RUN_CELLS_SQL},
tot as (select run_id, seed, sum(n) total from cells group by all),
pc as (
  select run_id, seed, label, sum(support) support, sum(predicted) predicted, sum(tp) tp from (
    select run_id, seed, y_true label, n support, 0 predicted, case when y_true = y_pred then n else 0 end tp from cells
    union all select run_id, seed, y_pred, 0, n, 0 from cells) group by all)
select run_id, seed, label, cast(tp as bigint) tp, cast(predicted - tp as bigint) fp,
  cast(support - tp as bigint) fn, cast(total - support - predicted + tp as bigint) tn
from pc join tot using (run_id, seed)""")
def q_confusion_ovr(spark, sf):
    cells = M.confusion_cells(runs(spark, sf), ["run_id", "seed"])
    return M.confusion_ovr(cells, ["run_id", "seed"])


@query("majority_baseline", f"""with counts as (select lang y_true, count(*) n from documents group by all),
maj as (select first(y_true order by n desc, y_true) majority from counts),
cells as (select y_true, majority y_pred, n from counts, maj)
select r.*, m.majority from {S.report('cells', [])} r, maj m""")
def q_majority_baseline(spark, sf):
    return M.majority_baseline(table(spark, sf, "documents"), "lang")


def report_runs(spark, sf, digits=6):
    return M.classification_report(runs(spark, sf), ["run_id", "seed"], digits=digits)


REPORT_RAW_SQL = f"""rep as (select * from {S.report('cells', ['run_id', 'seed'], rounded=False)})"""
LONG_SQL = """long as (unpivot rep on "precision", f1_weighted, f1_macro, accuracy, recall
                         into name metric value "value")"""
SUMMARY_SQL = f"""with {RUNS_SQL}, {RUN_CELLS_SQL}, {REPORT_RAW_SQL}, {LONG_SQL},
summ as (select run_id, metric, round_even(avg("value"), 3) mean, round_even(stddev_pop("value"), 3) std,
           cast(count(*) as bigint) n_seeds from long group by all)"""


@query("seeds_summary", f"{SUMMARY_SQL} select * from summ")
def q_seeds_summary(spark, sf):
    return M.seeds_summary(report_runs(spark, sf, None), ["run_id"])


@query("seeds_summary_text", f"""{SUMMARY_SQL}
select run_id,
  case metric when 'accuracy' then 0 when 'precision' then 1 when 'recall' then 2
              when 'f1_macro' then 3 else 4 end line_no,
  case metric when 'accuracy' then 'accuracy' when 'precision' then 'precision' when 'recall' then 'recall'
              when 'f1_macro' then 'f1 score macro' else 'f1 score weighted' end
    || ': ' || cast(mean as varchar) || ' +/- ' || cast(std as varchar) line
from summ""")
def q_seeds_summary_text(spark, sf):
    return M.seeds_summary_text(M.seeds_summary(report_runs(spark, sf, None), ["run_id"]), ["run_id"])


@query("result_table", f"""{SUMMARY_SQL.replace('round_even(avg("value"), 3)', 'round_even(avg("value"), 2)')
                              .replace('round_even(stddev_pop("value"), 3)', 'round_even(stddev_pop("value"), 2)')},
cell as (select run_id, metric, printf('%.2f', mean) || '(±' || printf('%.2f', std) || ')' c from summ)
select run_id,
  max(case when metric = 'accuracy' then c end) accuracy,
  max(case when metric = 'precision' then c end) "precision",
  max(case when metric = 'recall' then c end) recall,
  max(case when metric = 'f1_macro' then c end) f1_macro,
  max(case when metric = 'f1_weighted' then c end) f1_weighted
from cell group by run_id""")
def q_result_table(spark, sf):
    summ = M.seeds_summary(report_runs(spark, sf, None), ["run_id"], digits=2)
    cell = F.concat(F.format_number("mean", 2), F.lit("(±"), F.format_number("std", 2), F.lit(")"))
    order = ["accuracy", "precision", "recall", "f1_macro", "f1_weighted"]
    return summ.groupBy("run_id").pivot("metric", order).agg(F.first(cell))


# --- fixed values: models of the result table and their share of flipped predictions, in tenths ---
TABLE_MODELS = {"ROB-BASE": 3, "ROB-LRG": 1, "DEB-V3": 2}
TABLE_METRICS = ["accuracy", "f1_macro"]


@query("result_table_models", f"""with base as (
  select doc_id, 'quality' dataset, cast(quality as int) y_true from labels union all select doc_id, 'toxic', cast(toxic as int) from labels),
runs as (select dataset, model, seed, doc_id, y_true,
    case when {S.draw('seed', 'model', 'dataset', 'doc_id')} % 10 < tenths then 1 - y_true else y_true end y_pred
  from base, (values {', '.join(f"('{m}', {t})" for m, t in TABLE_MODELS.items())}) m(model, tenths),
    (values {', '.join(f'({s})' for s in SEEDS)}) s(seed)),
maj as (select dataset, first(y_true order by n desc, y_true) y_pred from (
  select dataset, y_true, count(*) n from base group by all) group by dataset),
every as (select dataset, model, seed, y_true, y_pred from runs
  union all select base.dataset, 'majority', 0, y_true, y_pred from base join maj using (dataset)),
cells as (select dataset, model, seed, y_true, y_pred, count(*) n from every group by all),
rep as (select * from {S.report('cells', ['dataset', 'model', 'seed'], rounded=False)}),
long as (unpivot rep on "precision", f1_weighted, f1_macro, accuracy, recall into name metric value "value"),
cell as (select dataset || '_' || metric point, model, printf('%.2f', round_even(avg("value"), 2)) || '(±' ||
           printf('%.2f', round_even(stddev_pop("value"), 2)) || ')' c from long group by dataset, metric, model)
select model, {', '.join(f"max(case when point = '{d}_{m}' then c end) {d}_{m}" for d in RUN_TASKS for m in TABLE_METRICS)}
from cell group by model""")
def q_result_table_models(spark, sf):
    """A row per model, columns per dataset: mean and spread over seeds, with the majority baseline as a model."""
    pairs = F.inline(F.array(*[F.struct(F.lit(t).alias("dataset"), F.col(t).cast("int").alias("y_true")) for t in RUN_TASKS]))
    base = table(spark, sf, "labels").select("doc_id", pairs)
    models = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("tenths")) for m, t in TABLE_MODELS.items()]))
    r = base.select("*", F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed")).select("*", models)
    flip = draw(F.col("seed"), F.col("model"), F.col("dataset"), F.col("doc_id")) % 10 < F.col("tenths")
    r = r.withColumn("y_pred", F.when(flip, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    rep = M.classification_report(r, ["dataset", "model", "seed"], digits=None)
    majority = M.majority_baseline(base, "y_true", ["dataset"], digits=None).withColumns(
        {"model": F.lit("majority"), "seed": F.lit(0)}).select(*rep.columns)
    summ = M.seeds_summary(rep.unionByName(majority), ["dataset", "model"], digits=2)
    cell = F.format_string("%.2f(±%.2f)", "mean", "std")
    return summ.select("model", F.concat_ws("_", "dataset", "metric").alias("point"), cell.alias("c")).groupBy("model").pivot(
        "point", [f"{d}_{m}" for d in RUN_TASKS for m in TABLE_METRICS]).agg(F.first("c"))


# --- fixed values: the epoch-wise learner of the fixtures ---
EPOCHS, STEPS, DIMS, RATE = 4, 1, 64, 0.1
EPOCH_TASK = "quality"


def epoch_fit(spark, sf):
    """The linear learner on the labelled corpus, split into train and val; its folder holds the log."""
    ids = corpus_ids(spark, sf)
    parts = SM.split_train_val(ids, SEED, "doc_id", TRAIN_FRAC, out="part").select("doc_id", "label", "part")
    texts = text_table(spark, sf, "documents", ["doc_id", "text"])
    rows = LN.with_features(parts.join(texts, "doc_id"), "text", DIMS).select("doc_id", "part", "label", "feats")
    return LN.fit(rows, "doc_id", scratch_dir(spark, "epochs"), EPOCH_TASK, SEED, DIMS, EPOCHS, STEPS, RATE)


def _epoch_sql():
    h = S.hkey(str(SEED), "doc_id")
    out = [f"""{CORPUS_SQL},
ranked as (select doc_id, label, text, row_number() over (order by {h}, doc_id) - 1 pos, count(*) over () n from corpus),
part as (select doc_id, label, text, case when pos < n - floor(cast({TRAIN_FRAC} as double) * n) then 'val' else 'train' end part
         from ranked),
cls as (select label, row_number() over (order by label) - 1 y, count(*) over () k, sum(nt) over () n, nt
        from (select label, count(*) filter (where part = 'train') nt from part group by label)),
r as materialized (select doc_id, part, y, cast(n as double) / (k * nt) cw, n from part join cls using (label)),
tok as (select doc_id, {S.draw("'0'", 'token')} % {DIMS} + 1 f from (select doc_id, unnest({S.tokens('text')}) token from part)),
fc as (select doc_id, f, count(*) m from tok group by all),
fx as materialized (select doc_id, f, m * cast({DIMS} as double) / sum(m) over (partition by doc_id) x from fc
                    union all select doc_id, 0, 1.0 from part),
w0 as (select f, y c, 0.0::double v from range(0, {DIMS + 1}) t(f), cls)"""]

    def forward(p, w):
        return f"""{p} as materialized (select doc_id, c, e / sum(e) over (partition by doc_id) p from (
  select doc_id, c, exp(z - max(z) over (partition by doc_id)) e from (
    select doc_id, c, sum(x * v) z from fx join {w} using (f) group by all)))"""

    for s in range(1, EPOCHS * STEPS + 1):
        out.append(forward(f"p{s}", f"w{s - 1}"))
        out.append(f"""w{s} as materialized (select w.f, w.c, w.v - {RATE} * coalesce(g.g, 0) v from w{s - 1} w left join (
  select f, c, sum(cw * (p - cast(y = c as int)) * x) / any_value(n) g from p{s} join r using (doc_id) join fx using (doc_id)
  where part = 'train' group by all) g using (f, c))""")
    ends = []
    for e in range(EPOCHS):
        out.append(forward(f"q{e}", f"w{(e + 1) * STEPS}"))
        ends.append(f"select cast({e} as int) epoch, * from q{e}")
    out.append(f"""stored as (select epoch, doc_id, part, y, cw, any_value(p) filter (where c = y) py,
  first(c order by p desc, c) y_pred from ({' union all '.join(ends)}) join r using (doc_id) group by all),
ecells as (select part, epoch, y y_true, y_pred, count(*) n from stored group by all),
losses as (select part, epoch, round(avg(-cw * ln(greatest(py, 1e-12))), 6) loss from stored group by all),
erep as (select '{EPOCH_TASK}' run_id, cast({SEED} as bigint) seed, * from {S.report('ecells', ['part', 'epoch'])} join losses using (part, epoch))""")
    return ",\n".join(out)


EPOCH_SQL = _epoch_sql()


@query("epoch_report", f"with {EPOCH_SQL} select * from erep")
def q_epoch_report(spark, sf):
    """Loss and metrics of the train and the val part after each epoch."""
    return epoch_fit(spark, sf).log(spark)


@query("metric_select", f"""with {EPOCH_SQL}
select run_id, part, epoch, f1_macro score, "precision" legacy_score from erep""")
def q_metric_select(spark, sf):
    rep = epoch_fit(spark, sf).log(spark)
    return rep.select("run_id", "part", "epoch", M.select_metric(rep, "f1_score_macro").alias("score"),
                      M.select_metric(rep, "f1_macro", legacy_default=True).alias("legacy_score"))


@query("best_epoch", f"""with {EPOCH_SQL}, v as (select * from erep where part = 'val')
select run_id, epoch, loss, f1_macro score,
  max(f1_macro) over (partition by run_id order by epoch rows between unbounded preceding and current row) best_score,
  f1_macro >= coalesce(max(f1_macro) over (partition by run_id order by epoch
                                           rows between unbounded preceding and 1 preceding), '-inf'::double) is_best
from v""")
def q_best_epoch(spark, sf):
    """Which epochs of the stored log were the best so far on the val part."""
    rep = epoch_fit(spark, sf).log(spark).where("part = 'val'")
    return M.best_so_far(rep.select("run_id", "epoch", "loss", F.col("f1_macro").alias("score")), ["run_id"], "epoch", "score")


@query("log_attempts", """with log as (select user_id, event_id, cast(event_id % 7 as int) epoch from events),
a as (select *, cast(sum(case when epoch = 0 then 1 else 0 end) over (partition by user_id order by event_id
                    rows between unbounded preceding and current row) as bigint) attempt from log)
select *, attempt = max(attempt) over (partition by user_id) is_last from a""")
def q_log_attempts(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 7).cast("int").alias("epoch"))
    return M.log_attempts(log, ["user_id"], "event_id", "epoch")


@query("regression_report", f"""with j as (select l_extendedprice y, l_quantity * p_retailprice yhat
                                      from lineitem join part on l_partkey = p_partkey),
agg as (select cast(count(*) as bigint) n, avg((y - yhat) * (y - yhat)) mse, avg(abs(y - yhat)) mae,
          sum((y - yhat) * (y - yhat)) sse, var_pop(y) * count(*) sst from j)
select n, {S.round_sig('mse')} mse, {S.round_sig('sqrt(mse)')} rmse, {S.round_sig('mae')} mae,
  {S.round_sig('1.0 - coalesce(sse / nullif(sst, 0), 0)')} r2 from agg""")
def q_regression_report(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    j = salted_join(li, part, "l_partkey", "p_partkey", ["l_orderkey", "l_linenumber"]).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"))
    return M.regression_report(j, "y", "yhat")


@query("label_distribution", """with c as (select quality label, cast(count(*) as bigint) n from labels group by all)
select *, max(n) over () max_n, min(n) over () min_n from c""")
def q_label_distribution(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").alias("label"))
    return M.label_distribution(lab, "label")


@query("class_list", """select cast(count(distinct lang) as bigint) n_classes,
  string_agg(distinct lang, '|' order by lang) classes from documents""")
def q_class_list(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.countDistinct("lang").cast("bigint").alias("n_classes"),
                 F.array_join(F.sort_array(F.collect_set("lang")), "|").alias("classes"))


@query("dup_audit", """with g as (select text, count(*) n from documents group by text)
select cast(sum(n) as bigint) n_rows, cast(count(*) as bigint) n_distinct,
  cast(sum(n - 1) as bigint) n_dup, cast(count(*) filter (where n > 1) as bigint) n_dup_groups from g""")
def q_dup_audit(spark, sf):
    d = table(spark, sf, "documents")
    # group on a 128-bit digest: the shuffle carries 32 bytes per row, not the whole text
    g = d.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").cast("bigint").alias("n_rows"), F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
                 F.sum(F.col("n") - 1).cast("bigint").alias("n_dup"),
                 F.count(F.when(F.col("n") > 1, 1)).cast("bigint").alias("n_dup_groups"))


@query("class_weights", """with c as (select quality label, cast(count(*) as bigint) n from labels group by all)
select label, n, round(cast(sum(n) over () as double) / (count(*) over () * n), 6) w from c""")
def q_class_weights(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").alias("label"))
    return M.class_weights(lab, "label").withColumn("w", F.round("w", 6))
