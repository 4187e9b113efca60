"""Model queries: naive Bayes train / predict / auto-label, learning curve, LR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.operators import model_store as MS
from textlab.operators import models as MD
from textlab.operators import sampling as SM
from textlab.operators.zeroshot import lexicon_predict
from textlab.plans import sqlfrag as S
from textlab.plans.q_sampling import HOLD_SQL, SEED, SIZES, corpus, hold, part_a, part_a_ids
from textlab.plans.registry import query, table, text_table
from textlab.session import cut_lineage, scratch_dir


def nb_model(spark, sf):
    return MD.nb_train(part_a(spark, sf), "text", "label")


def part_b(spark, sf):
    return hold(spark, sf).select("doc_id", "label", "text")


def nb_sql(train: str, score: str, mc: list[str] = ()) -> str:
    """NB train on relation ``train`` (mc..., label, text), score ``score``
    (mc..., doc_id, text); result relation ``pred`` (mc..., doc_id, y_pred)."""
    g = "".join(f"{c}, " for c in mc)
    on_m = " and ".join([f"x.{c} = y.{c}" for c in mc]) or "true"
    return f"""tok as (select {g}label, unnest({S.tokens('text')}) token from {train}),
tc as (select {g}label, token, count(*) n from tok group by all),
v as (select {g}count(distinct token) V from tc {'group by ' + ', '.join(mc) if mc else ''}),
ct as (select {g}label, sum(n) total from tc group by all),
pr as (select {g}label, count(*) nd from {train} group by all),
cls as (select x.*, ln(cast(x.nd as double) / sum(x.nd) over ({'partition by ' + ', '.join('x.' + c for c in mc) if mc else ''})) log_prior,
          ln(1.0 / (coalesce(ct.total, 0) + y.V)) ldef, coalesce(ct.total, 0) total, y.V
        from pr x left join ct using ({g}label) join v y on {on_m}),
lp as (select {g}tc.label, tc.token, ln(cast(tc.n + 1 as double) / (cls.total + cls.V)) logp, cls.ldef
       from tc join cls using ({g}label)),
st as (select {g}doc_id, unnest({S.tokens('text')}) token from {score}),
dtc as (select {g}doc_id, token, count(*) n from st group by all),
nd as (select {g}doc_id, sum(n) nd from dtc where ({g}token) in (select ({g}token) from tc) group by all),
s as (select {g}dtc.doc_id, lp.label, sum(dtc.n * (lp.logp - lp.ldef)) s from dtc join lp using ({g}token) group by all),
sc as (select {''.join(f'b.{c}, ' for c in mc)}b.doc_id, cls.label,
         cls.log_prior + coalesce(nd.nd, 0) * cls.ldef + coalesce(s.s, 0) score
       from {score} b join cls {'using (' + ', '.join(mc) + ')' if mc else 'on true'}
       left join nd on nd.doc_id = b.doc_id {''.join(f' and nd.{c} = b.{c}' for c in mc)}
       left join s on s.doc_id = b.doc_id and s.label = cls.label {''.join(f' and s.{c} = b.{c}' for c in mc)}),
pred as (select {g}doc_id, first(label order by score desc, label) y_pred from sc group by all)"""


@query("nb_train", f"""with {HOLD_SQL},
tok as (select label, unnest({S.tokens('text')}) token from a),
tc as (select label, token, count(*) n from tok group by all),
v as (select count(distinct token) V from tc),
ct as (select label, sum(n) total from tc group by label)
select tc.label, tc.token, tc.n, round(ln(cast(n + 1 as double) / (total + V)), 6) logp
from tc join ct using (label), v""")
def q_nb_train(spark, sf):
    m = nb_model(spark, sf)
    return m.token_table.select("label", "token", "n", F.round("logp", 6).alias("logp"))


@query("nb_predict", f"""with {HOLD_SQL},
b as (select h.doc_id, c.text from hold h join corpus c using (doc_id)),
{nb_sql('a', 'b')}
select doc_id, y_pred from pred""")
def q_nb_predict(spark, sf):
    return MD.nb_predict(nb_model(spark, sf), part_b(spark, sf), "doc_id", "text").select("doc_id", "y_pred")


def latest_nb(spark, root, run_id, which="last"):
    """A stored model, as another session would read it."""
    return MS.load_nb(spark, root, run_id, SEED, which)


@query("auto_label", f"""with corpus as (select l.doc_id, l.quality label, d.text from labels l join documents d using (doc_id)),
u as (select doc_id, text from documents where doc_id not in (select doc_id from labels)),
{nb_sql('corpus', 'u')},
idx as (select label, cast(row_number() over (order by label) - 1 as int) y_idx from (select distinct label from corpus))
select doc_id, y_pred, y_idx from pred join idx on y_pred = label""")
def q_auto_label(spark, sf):
    """Train and store a model, then label the unlabelled documents with what the store's ``last`` points to."""
    root = scratch_dir(spark, "models")
    MS.save_nb(MD.nb_train(corpus(spark, sf), "text", "label"), root, "quality", SEED)
    model, index = latest_nb(spark, root, "quality")
    docs = text_table(spark, sf, "documents", ["doc_id", "text"])
    unlabelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    out = MD.nb_predict(model, unlabelled, "doc_id", "text").select("doc_id", "y_pred")
    return out.join(index.select(F.col("label").alias("y_pred"), F.col("idx").alias("y_idx")), "y_pred").select(
        "doc_id", "y_pred", "y_idx")


#: Training sizes of the stored versions, in the order of their epochs.
VERSION_SIZES = [200, 1000, 50]


@query("model_store", f"""with {HOLD_SQL},
n as (select count(*) n from a),
d as (select unnest(range({max(VERSION_SIZES)})) i),
dd as (select i, {S.draw(str(SEED), "'size'", 'i')} % greatest(n, 1) pos from d, n where n > 0),
r as (select doc_id, label, text, row_number() over (order by {S.hkey(str(SEED), 'doc_id')}, doc_id) - 1 pos from a),
tr as (select cast(s.version as bigint) "version", r.label, r.text from dd join r using (pos),
       (values {', '.join(f'({k}, {n})' for k, n in enumerate(VERSION_SIZES))}) s("version", n_train) where dd.i < s.n_train),
models as (select distinct "version" from tr),
b as (select m."version", h.doc_id, c.text, c.label y_true from hold h join corpus c using (doc_id), models m),
{nb_sql('tr', 'b', ['"version"'])},
sc0 as (select "version", round(avg(cast(p.y_pred = b.y_true as int)), 6) score from b join pred p using ("version", doc_id) group by all),
fl as (select *, score >= coalesce(max(score) over (order by "version" rows between unbounded preceding and 1 preceding), -1) is_best
       from sc0),
docs as (select "version", cast(count(*) as bigint) n_docs from tr group by all),
toks as (select "version", cast(sum(n) as bigint) n_tokens from tc group by all)
select "version", cast("version" as int) epoch, score, is_best, "version" = max("version") over () is_last,
  "version" = max("version") filter (where is_best) over () is_pointed_best, n_docs, n_tokens
from fl join docs using ("version") join toks using ("version")""")
def q_model_store(spark, sf):
    """Versions of one run, each stored with its hold-out accuracy; what the pointers resolve to, and the counts
    that a reader finds in each."""
    ids = part_a_ids(spark, sf)
    n_a = ids.count()
    if not n_a:
        return spark.createDataFrame([], "version long, epoch int, score double, is_best boolean, is_last boolean, "
                                         "is_pointed_best boolean, n_docs long, n_tokens long")
    sub = SM.subset_sizes(ids, SEED, "doc_id", VERSION_SIZES, n=n_a).select("n_train", "doc_id", "label")
    sub = sub.join(text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id")
    grid = MD.nb_train(sub, "text", "label", model_cols=["n_train"])
    b = part_b(spark, sf)
    hits = MD.nb_predict(grid, b, "doc_id", "text").join(b.select("doc_id", "label"), "doc_id")
    score = {r.n_train: r.score for r in hits.groupBy("n_train").agg(
        F.round(F.avg((F.col("y_pred") == F.col("label")).cast("int")), 6).alias("score")).collect()}
    root = scratch_dir(spark, "models")
    for epoch, n in enumerate(VERSION_SIZES):
        one = MD.nb_from_counts(grid.counts.where(F.col("n_train") == n).drop("n_train"))
        MS.save_nb(one, root, "quality", SEED, epoch, score[n])
    found = []
    for r in MS.versions(spark, root, "quality", SEED):
        model, index = latest_nb(spark, root, "quality", r.version)
        found.append(index.agg(F.sum("n_docs").alias("n_docs")).select(
            F.lit(r.version).alias("version"), "n_docs", model.counts.where("token is not null").agg(F.sum("n")).scalar()
            .alias("n_tokens")))
    counts = reduce(lambda x, y: x.unionByName(y), found)
    last, best = (MS.resolve(spark, root, "quality", SEED, w).version for w in MS.POINTERS)
    return MS.manifest(spark, root).join(counts, "version").select(
        "version", "epoch", "score", "is_best", (F.col("version") == last).alias("is_last"),
        (F.col("version") == best).alias("is_pointed_best"), "n_docs", "n_tokens")


# --- fixed values: datasets of the size study with the words of their zero-shot scorers (no hit: class 0) ---
STUDY = {"quality": ["the", "and", "of", "de", "la", "der", "die", "und"], "toxic": ["idiot", "moron", "stupid", "trash"]}
STUDY_SEEDS = [1234, 3456, 5678]
STUDY_GROUP = ["dataset", "anchor", "n_train"]


def study_labels(spark, sf):
    """(dataset, doc_id, label) of every dataset of the study."""
    lab = table(spark, sf, "labels")
    pairs = F.inline(F.array(*[F.struct(F.lit(d).alias("dataset"), F.col(d).cast("int").alias("label")) for d in STUDY]))
    return lab.select("doc_id", pairs)


def study_report(spark, sf):
    """The five metrics per dataset, size and seed: zero-shot scorer (size 0), five sizes, whole training part."""
    ids = part_a_ids(spark, sf).select("doc_id")
    n_a = ids.count()
    labels = study_labels(spark, sf)
    full = ids.select(F.lit(0).cast("bigint").alias("seed"), F.lit(len(SIZES)).alias("band"), "doc_id",
                      F.lit(1).cast("bigint").alias("m"))
    uses = SM.size_bands(ids, STUDY_SEEDS, SEED, "doc_id", SIZES, n_a).unionByName(full).join(labels, "doc_id")
    uses = uses.groupBy("doc_id").agg(F.collect_list(F.struct("dataset", "seed", "band", "label", "m")).alias("uses"))
    texts = text_table(spark, sf, "documents", ["doc_id", "text"])
    counts = MD.nb_counts_of_uses(uses.join(texts, "doc_id"), "text", "uses", ["dataset", "seed", "band"])
    # a band's counts belong to its size and all larger ones; the whole part's to itself
    sizes = F.when(F.col("band") == len(SIZES), F.array(F.lit(n_a).cast("bigint"))).otherwise(
        F.slice(F.array(*[F.lit(n).cast("bigint") for n in sorted(SIZES)]), F.col("band") + 1, len(SIZES)))
    counts = (counts.withColumn("full", F.col("band") == len(SIZES))
              .select("dataset", "seed", "full", "label", "token", "n", F.explode(sizes).alias("n_train"))
              .groupBy("dataset", "seed", "full", "n_train", "label", "token").agg(F.sum("n").alias("n")))
    model = MD.nb_from_counts(cut_lineage(counts), ["dataset", "seed", "full", "n_train"])
    b = part_b(spark, sf).select("doc_id", "text")
    every_seed = F.array(*[F.lit(x).cast("bigint") for x in STUDY_SEEDS])
    # what does not depend on the seed is scored once
    pred = MD.nb_predict(model, b, "doc_id", "text").select(
        "dataset", F.when(F.col("full"), "full").otherwise("size").alias("anchor"), "n_train", "doc_id", "y_pred",
        F.explode(F.when(F.col("full"), every_seed).otherwise(F.array("seed"))).alias("seed"))
    for name, words in STUDY.items():
        zero = lexicon_predict(b, "text", [0, 1], {1: words}).select(
            F.lit(name).alias("dataset"), F.lit("zero").alias("anchor"), F.lit(0).cast("bigint").alias("n_train"), "doc_id",
            "y_pred", F.explode(every_seed).alias("seed"))
        pred = pred.unionByName(zero)
    truth = labels.withColumnRenamed("label", "y_true")
    return M.classification_report(pred.join(truth, ["dataset", "doc_id"]), [*STUDY_GROUP, "seed"], digits=None)


def _study_sql():
    mc = ["dataset", "seed", "n_train", '"full"']
    seeds = ", ".join(f"({x})" for x in STUDY_SEEDS)
    zero = " union all ".join(
        f"""select '{name}' dataset, 'zero' anchor, cast(0 as bigint) n_train, s.seed, h.doc_id,
  cast(list_has_any({S.tokens('c.text')}, {words}) as int) y_pred from hold h join corpus c using (doc_id), (values {seeds}) s(seed)"""
        for name, words in STUDY.items())
    return f"""with {HOLD_SQL},
lab as ({' union all '.join(f"select '{d}' dataset, doc_id, cast({d} as int) label from labels" for d in STUDY)}),
n as (select count(*) n from a),
d as (select s.seed, unnest(range({max(SIZES)})) i from (values {seeds}) s(seed)),
dd as (select seed, i, {S.draw('seed', "'size'", 'i')} % greatest(n, 1) pos from d, n where n > 0),
r as (select doc_id, text, row_number() over (order by {S.hkey(str(SEED), 'doc_id')}, doc_id) - 1 pos from a),
tr as (select lab.dataset, dd.seed, cast(s.n_train as bigint) n_train, false "full", lab.label, r.text
       from dd join r using (pos) join lab using (doc_id), (values {', '.join(f'({x})' for x in SIZES)}) s(n_train)
       where dd.i < s.n_train
       union all
       select lab.dataset, s.seed, (select n from n), true, lab.label, a.text from a join lab using (doc_id), (values {seeds}) s(seed)),
models as (select distinct dataset, seed, n_train, "full" from tr),
b as (select m.*, h.doc_id, c.text from hold h join corpus c using (doc_id), models m),
{nb_sql('tr', 'b', mc)},
scored as (select dataset, case when "full" then 'full' else 'size' end anchor, n_train, seed, doc_id, y_pred from pred
           union all {zero}),
cells as (select dataset, anchor, n_train, seed, lab.label y_true, y_pred, count(*) n from scored join lab using (dataset, doc_id)
          group by all),
rep as (select * from {S.report('cells', [*STUDY_GROUP, 'seed'], rounded=False)}),
long as (unpivot rep on "precision", f1_weighted, f1_macro, accuracy, recall into name metric value "value"),
summ as (select dataset, anchor, n_train, metric, round_even(avg("value"), 3) mean, round_even(stddev_pop("value"), 3) std,
           cast(count(*) as bigint) n_seeds from long group by all)"""


@query("learning_curve", f"{_study_sql()} select * from summ")
def q_learning_curve(spark, sf):
    """Mean and spread over the seeds of every metric, by dataset and training size."""
    return M.seeds_summary(study_report(spark, sf), STUDY_GROUP)


#: Columns of the pivoted study: the zero-shot anchor, the sizes, the whole training part.
STUDY_POINTS = ["zero", *[f"n_{n}" for n in SIZES], "whole"]


@query("learning_curve_table", f"""{_study_sql()},
cell as (select dataset, metric, case anchor when 'zero' then 'zero' when 'full' then 'whole' else 'n_' || n_train end point,
  printf('%.3f', mean) || '(±' || printf('%.3f', std) || ')' c from summ)
select dataset, metric, {', '.join(f"max(case when point = '{p}' then c end) {p}" for p in STUDY_POINTS)} from cell group by all""")
def q_learning_curve_table(spark, sf):
    """The study with a row per dataset and metric and a column per training size."""
    summ = M.seeds_summary(study_report(spark, sf), STUDY_GROUP)
    point = F.when(F.col("anchor") == "zero", "zero").when(F.col("anchor") == "full", "whole").otherwise(
        F.concat(F.lit("n_"), F.col("n_train").cast("string")))
    cell = F.format_string("%.3f(±%.3f)", "mean", "std")
    return summ.select("dataset", "metric", point.alias("point"), cell.alias("c")).groupBy("dataset", "metric").pivot(
        "point", STUDY_POINTS).agg(F.first("c"))


def lr_model(spark, sf):
    a = part_a(spark, sf)
    if a.isEmpty():  # nothing to learn from (tiny data): no model
        return None
    w = M.class_weights(a, "label")
    return MD.lr_fit(SM.weight_rows(a, w, "label"), "text", "label", "w", max_iter=30)


@query("lr_predict", f"""with {HOLD_SQL}, classes as (select distinct label from a)
select doc_id, true known_class from hold where exists (select 1 from a)""")
def q_lr_predict(spark, sf):
    """Predictions of the hold-out: one per document, each a class of the training part."""
    model = lr_model(spark, sf)
    b = part_b(spark, sf)
    if model is None:
        return b.where(F.lit(False)).select("doc_id", F.lit(True).alias("known_class"))
    classes = part_a_ids(spark, sf).select(F.col("label").cast("int").alias("y_pred"), F.lit(True).alias("hit")).distinct()
    out = MD.lr_predict(model, b, "doc_id").join(classes, "y_pred", "left")
    return out.select("doc_id", F.coalesce("hit", F.lit(False)).alias("known_class"))


@query("model_roundtrip", f"""with {HOLD_SQL}, n as (select case when (select count(*) from a) > 0 then count(*) else 0 end n from hold)
select cast(n as bigint) n, cast(n as bigint) n_equal from n""")
def q_model_roundtrip(spark, sf):
    """Save and reload the fitted pipeline; predictions must be identical."""
    model = lr_model(spark, sf)
    if model is None:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_equal"))
    path = scratch_dir(spark, "model")
    MD.save_model(model, path)
    again = MD.load_model(path)
    b = part_b(spark, sf)
    p1 = MD.lr_predict(model, b, "doc_id", "p1")
    p2 = MD.lr_predict(again, b, "doc_id", "p2")
    j = p1.join(p2, "doc_id")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.count(F.when(F.col("p1") == F.col("p2"), 1)).cast("bigint").alias("n_equal"))
