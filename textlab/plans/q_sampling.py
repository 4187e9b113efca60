"""Sampling queries on the labelled corpus (labels joined to documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.operators import sampling as SM
from textlab.plans import sqlfrag as S
from textlab.plans.registry import query, table, text_table
from textlab.session import cut_lineage

# --- fixed values: seed and sizes of the replication protocol ---
SEED = 1234
HOLDOUT_N = 200
TRAIN_FRAC = 0.9
SIZES = [50, 100, 200, 500, 1000]


def corpus(spark, sf):
    """The labelled corpus: (doc_id, label, text)."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return lab.join(text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id")


def corpus_ids(spark, sf):
    """The labelled corpus without its text: (doc_id, label)."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return lab.join(table(spark, sf, "documents").select("doc_id"), "doc_id")


def hold_keys(spark, sf):
    return SM.holdout_keys(corpus_ids(spark, sf), SEED, "doc_id", HOLDOUT_N)


def hold(spark, sf):
    """The N-row hold-out (doc_id, label, text, pos).  The N keys are chosen
    on the id-only corpus; their texts are then fetched by a broadcast join
    of those N rows (a parameter bound) against the documents, so no text is
    shuffled."""
    keys = SM.holdout(corpus_ids(spark, sf), SEED, "doc_id", HOLDOUT_N)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(keys), "doc_id").select("doc_id", "label", "text", "pos")


def part_a(spark, sf):
    return SM.complement(corpus(spark, sf), F.broadcast(hold_keys(spark, sf)), "doc_id")  # N ids


def part_a_ids(spark, sf):
    return SM.complement(corpus_ids(spark, sf), F.broadcast(hold_keys(spark, sf)), "doc_id")  # N ids


H = S.hkey(str(SEED), "doc_id")
CORPUS_SQL = "corpus as (select l.doc_id, l.quality label, d.text from labels l join documents d using (doc_id))"
HOLD_SQL = f"""{CORPUS_SQL},
ranked as (select doc_id, label, cast(row_number() over (order by {H}, doc_id) - 1 as bigint) pos from corpus),
hold as (select doc_id, pos from ranked where pos < {HOLDOUT_N}),
a as (select doc_id, label, text from corpus where doc_id not in (select doc_id from hold))"""


@query("shuffle", f"""with {HOLD_SQL} select doc_id, pos from ranked""")
def q_shuffle(spark, sf):
    return SM.seeded_rank(corpus_ids(spark, sf).select("doc_id"), SEED, "doc_id").select("doc_id", "pos")


@query("holdout", f"with {HOLD_SQL} select doc_id, pos from hold")
def q_holdout(spark, sf):
    return hold(spark, sf).select("doc_id", "pos")


@query("complement", f"with {HOLD_SQL} select doc_id, label from a")
def q_complement(spark, sf):
    return part_a(spark, sf).select("doc_id", "label")


SPLIT_SQL = f"""{HOLD_SQL},
sa as (select doc_id, label, row_number() over (order by {H}, doc_id) - 1 pos, count(*) over () n from a),
split as (select doc_id, label,
  case when pos < n - floor(cast({TRAIN_FRAC} as double) * n) then 'val' else 'train' end split from sa)"""


@query("split_train_val", f"with {SPLIT_SQL} select doc_id, split from split")
def q_split_train_val(spark, sf):
    a = part_a(spark, sf).select("doc_id")  # project before the rank: ids only through the shuffles
    return SM.split_train_val(a, SEED, "doc_id", TRAIN_FRAC).select("doc_id", "split")


def resample_sql(agg: str, src: str, by: list[str]) -> str:
    g = "".join(f"{c}, " for c in by)
    part = f"partition by {', '.join(by)}" if by else ""
    part_l = f"partition by {', '.join([*by, 'label'])}"
    draw = S.draw(str(SEED), *by, "label", "i")
    return f"""c as (select {g}label, count(*) n from {src} group by all),
t as (select {g}{agg}(n) m from c {'group by ' + ', '.join(by) if by else ''}),
d as (select {g}c.label, c.n, unnest(range(t.m)) i from c join t {'using (' + ', '.join(by) + ')' if by else 'on true'}),
dd as (select {g}label, i, {draw} % n pos from d),
r as (select {g}doc_id, label, row_number() over ({part_l} order by {H}, doc_id) - 1 pos from {src})
select {g}dd.label, dd.i, r.doc_id from dd join r using ({g}label, pos)"""


@query("resample_up", f"with {CORPUS_SQL}, {resample_sql('max', 'corpus', [])}")
def q_resample_up(spark, sf):
    c = corpus_ids(spark, sf)
    return SM.resample(c, SEED, "doc_id", "label", "upsampling").select("label", "i", "doc_id")


@query("resample_under", f"with {CORPUS_SQL}, {resample_sql('min', 'corpus', [])}")
def q_resample_under(spark, sf):
    c = corpus_ids(spark, sf)
    return SM.resample(c, SEED, "doc_id", "label", "undersampling").select("label", "i", "doc_id")


@query("resample_split", f"with {SPLIT_SQL}, {resample_sql('max', 'split', ['split'])}")
def q_resample_split(spark, sf):
    sp = SM.split_train_val(part_a(spark, sf).select("doc_id", "label"), SEED, "doc_id", TRAIN_FRAC)
    sp = cut_lineage(sp)  # read three times by the resampler: compute the split once
    return SM.resample(sp, SEED, "doc_id", "label", "upsampling", by=["split"]).select("split", "label", "i", "doc_id")


@query("subset_sizes", f"""with {HOLD_SQL},
n as (select count(*) n from a),
d as (select unnest(range({max(SIZES)})) i),
dd as (select i, {S.draw(str(SEED), "'size'", 'i')} % greatest(n, 1) pos from d, n where n > 0),
r as (select doc_id, row_number() over (order by {H}, doc_id) - 1 pos from a),
j as (select i, doc_id from dd join r using (pos))
select cast(s.n_train as bigint) n_train, j.i, j.doc_id
from j, (values {', '.join(f'({x})' for x in SIZES)}) s(n_train) where j.i < s.n_train""")
def q_subset_sizes(spark, sf):
    return SM.subset_sizes(part_a(spark, sf).select("doc_id"), SEED, "doc_id", SIZES).select("n_train", "i", "doc_id")


@query("loss_weight", f"""with {CORPUS_SQL},
c as (select label, count(*) n from corpus group by all),
w as (select label, cast(sum(n) over () as double) / (count(*) over () * n) w from c)
select doc_id, label, round(w, 6) w from corpus join w using (label)""")
def q_loss_weight(spark, sf):
    c = corpus_ids(spark, sf)
    w = M.class_weights(c, "label")
    return SM.weight_rows(c, w, "label").select("doc_id", "label", F.round("w", 6).alias("w"))


@query("sink_holdout", f"""with {HOLD_SQL}
select doc_id, label, case when doc_id in (select doc_id from hold) then 'B' else 'A' end split, md5(text) h from corpus""")
def q_sink_holdout(spark, sf):
    """Persist the labelled corpus, texts beside the truth, with its A/B split, partitioned by split."""
    from textlab.session import scratch_dir
    from textlab.sources import io as IO
    keys = SM.holdout_keys(corpus_ids(spark, sf), SEED, "doc_id", HOLDOUT_N).withColumn("_b", F.lit(True))
    tagged = corpus(spark, sf).join(F.broadcast(keys), "doc_id", "left").select(  # N keys: parameter bound
        "doc_id", "label", "text", F.when(F.col("_b"), F.lit("B")).otherwise(F.lit("A")).alias("split"))
    path = scratch_dir(spark, "split")
    IO.write_partitioned(tagged, path, ["split"], mode="overwrite")
    return spark.read.parquet(path).select("doc_id", "label", "split", F.md5("text").alias("h"))


@query("class_weights_split", f"""with {SPLIT_SQL},
k as (select count(distinct label) k from split),
t as (select label, count(*) n from split where split = 'train' group by label)
select label, cast(n as bigint) n, round(cast(sum(n) over () as double) / (k * n), 6) w from t, k""")
def q_class_weights_split(spark, sf):
    """Weights from the train part, for the classes of train and val together; a class that train lacks is an error."""
    parts = SM.split_train_val(part_a_ids(spark, sf), SEED, "doc_id", TRAIN_FRAC).select("label", "split")
    train, val = (parts.where(F.col("split") == p).select("label") for p in ("train", "val"))
    return M.class_weights(train, "label", train.unionByName(val)).withColumn("w", F.round("w", 6))


@query("class_list_split", f"""with {SPLIT_SQL}
select cast(count(distinct label) as bigint) n_classes, coalesce(string_agg(distinct cast(label as varchar), '|' order by cast(label as varchar)), '')
  classes, cast(count(*) as bigint) n_rows from split""")
def q_class_list_split(spark, sf):
    """Classes of the bag union of the train and val parts."""
    parts = SM.split_train_val(part_a_ids(spark, sf), SEED, "doc_id", TRAIN_FRAC).select("label", "split")
    both = parts.where("split = 'train'").select("label").unionByName(parts.where("split = 'val'").select("label"))
    return both.agg(F.countDistinct("label").cast("bigint").alias("n_classes"),
                    F.array_join(F.sort_array(F.collect_set(F.col("label").cast("string"))), "|").alias("classes"),
                    F.count(F.lit(1)).cast("bigint").alias("n_rows"))
