"""Feature queries: label index, one-hot, softmax, loss, encoder, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions.arrays import argmax, join_numbers, softmax
from textlab.functions.text import tokens
from textlab.operators import features as FE
from textlab.operators import metrics as M
from textlab.operators.zeroshot import LEXICON, LEXICON_LABELS, with_lexicon_hits
from textlab.plans import sqlfrag as S
from textlab.plans.q_sampling import HOLD_SQL, part_a
from textlab.plans.registry import query, table, text_table

# --- fixed values: encoder length of the fixtures ---
MAX_LEN = 512


CLS_SQL = """c as (select lang, cast(row_number() over (order by lang) - 1 as int) idx, count(*) over () k
             from (select distinct lang from documents where lang is not null))"""


def docs_indexed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return FE.with_index(d, "lang", FE.class_index(d, "lang")).where(F.col("idx").isNotNull())


@query("label_index", f"with {CLS_SQL} select doc_id, lang, idx from documents join c using (lang)")
def q_label_index(spark, sf):
    return docs_indexed(spark, sf).select("doc_id", "lang", "idx")


@query("one_hot", f"""with {CLS_SQL}
select doc_id, array_to_string(list_transform(range(k), lambda j: case when j = idx then 1 else 0 end), ',') vec
from documents join c using (lang)""")
def q_one_hot(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: (j == F.col("idx")).cast("int"))
    return docs_indexed(spark, sf).select("doc_id", join_numbers(hot).alias("vec"))


def hits_sql(lex: dict) -> str:
    """Per document: list of lexicon hits in order of the data's classes; a class without a word list has none."""
    vals = ", ".join(f"('{w}', '{lab}')" for lab in sorted(lex) for w in lex[lab])
    return f"""{CLS_SQL},
tok as (select doc_id, unnest({S.tokens('text')}) token from documents),
lx as (select token, label from (values {vals}) v(token, label)),
hc as (select t.doc_id, lx.label, count(*) n from tok t join lx using (token) group by all),
h as (select d.doc_id, d.lang, list(coalesce(hc.n, 0) order by c.idx) hits
      from documents d cross join c left join hc on hc.doc_id = d.doc_id and hc.label = c.lang
      group by d.doc_id, d.lang),
p as (select doc_id, lang, hits, list_transform(hits, lambda x: exp(x - list_max(hits))) e from h),
pp as (select doc_id, lang, hits, list_transform(e, lambda x: x / list_sum(e)) p from p)"""


def probs(spark, sf):
    """Documents with the class list of the data, softmax of their hits, and their own class's place."""
    d = text_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    d = with_lexicon_hits(d, "text", LEXICON_LABELS, LEXICON, "own")
    classes = table(spark, sf, "documents").agg(F.sort_array(F.collect_set("lang")).alias("c")).scalar()  # one row
    d = d.withColumn("classes", classes)

    def hits(label):
        place = F.array_position(F.array(*[F.lit(c) for c in LEXICON_LABELS]), label)
        return F.when(place > 0, F.get("own", (place - 1).cast("int"))).otherwise(F.lit(0).cast("bigint"))

    d = d.withColumn("hits", F.transform("classes", hits)).withColumn("p", softmax(F.col("hits")))
    place = F.array_position("classes", F.col("lang"))
    return d.withColumn("idx", F.when(place > 0, (place - 1).cast("int")))


@query("softmax", f"""with {hits_sql(LEXICON)}
select doc_id, array_to_string(list_transform(p, lambda x: printf('%.6f', x)), ',') p from pp""")
def q_softmax(spark, sf):
    d = probs(spark, sf)
    return d.select("doc_id", FE.format_probs(F.col("p")).alias("p"))


@query("label_inverse", f"""with {hits_sql(LEXICON)},
am as (select doc_id, list_position(p, list_max(p)) - 1 idx from pp)
select doc_id, c.lang y_pred from am join c using (idx)""")
def q_label_inverse(spark, sf):
    d = probs(spark, sf)
    return d.select("doc_id", F.get("classes", argmax(F.col("p"))).alias("y_pred"))


@query("weighted_ce", f"""with {hits_sql(LEXICON)},
cnt as (select lang, count(*) n from documents where lang is not null group by lang),
w as (select lang, cast(sum(n) over () as double) / (count(*) over () * n) w from cnt),
t as (select pp.doc_id, w.w, greatest(p[c.idx + 1], 1e-12) py from pp join c using (lang) join w using (lang))
select cast(count(*) as bigint) n, round(avg(-w * ln(py)), 6) loss, round(avg(-ln(py)), 6) loss_unweighted from t""")
def q_weighted_ce(spark, sf):
    d = probs(spark, sf).where(F.col("idx").isNotNull())
    w = M.class_weights(table(spark, sf, "documents").select("lang"), "lang")
    j = d.join(w.select("lang", "w"), "lang")  # one row per class
    term = FE.weighted_ce(F.col("p"), F.col("idx"), F.col("w"))
    plain = FE.weighted_ce(F.col("p"), F.col("idx"), F.lit(1.0))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg(term), 6).alias("loss"),
                 F.round(F.avg(plain), 6).alias("loss_unweighted"))


@query("truncation_audit", f"""with t as (select len({S.tokens('text')}) + 2 n from documents)
select cast(count(*) as bigint) n_texts, cast(count(*) filter (where n >= {MAX_LEN}) as bigint) n_ge,
  cast(count(*) filter (where n > {MAX_LEN}) as bigint) n_gt from t""")
def q_truncation_audit(spark, sf):
    d = text_table(spark, sf, "documents", ["text"]).select(tokens("text").alias("toks"))
    return d.agg(F.count(F.lit(1)).cast("bigint").alias("n_texts"), *FE.truncation_counts(F.col("toks"), MAX_LEN))


@query("encode_pad_mask", f"""with t as (select doc_id, {S.tokens('text')} toks from documents),
e as (select doc_id, list_concat([{FE.CLS_ID}::bigint],
        list_transform(toks[1:{MAX_LEN - 2}], lambda x: {S.draw("'0'", 'x')} % {FE.VOCAB} + {FE.FIRST_TOKEN_ID}),
        [{FE.SEP_ID}::bigint]) ids from t)
select doc_id,
  md5(array_to_string(list_concat(ids, list_transform(range({MAX_LEN} - len(ids)), lambda x: {FE.PAD_ID}::bigint)), ',')) h,
  cast(len(ids) as bigint) n_mask from e""")
def q_encode_pad_mask(spark, sf):
    d = text_table(spark, sf, "documents", ["doc_id", "text"]).select(
        "doc_id", FE.encode(tokens("text"), MAX_LEN).alias("ids"))
    mask = FE.attention_mask(F.col("ids"))
    return d.select("doc_id", F.md5(join_numbers(F.col("ids"))).alias("h"),
                    F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mask"))


# --- fixed values: size of the learned vocabulary of the fixtures ---
LEARNED = 2000
VOCAB_SQL = f"""{HOLD_SQL},
vc as (select token, count(*) n from (select unnest({S.tokens('text')}) token from a) group by token),
vocab as (select token, n, cast(row_number() over (order by n desc, token) + {FE.FIRST_TOKEN_ID} as bigint) id from vc
          order by n desc, token limit {LEARNED})"""


def vocabulary(spark, sf):
    return FE.learn_vocabulary(part_a(spark, sf).select("text"), "text", LEARNED)


@query("vocabulary", f"with {VOCAB_SQL} select token, id, cast(n as bigint) n from vocab")
def q_vocabulary(spark, sf):
    """Token ids by frequency in the training part."""
    return vocabulary(spark, sf)


@query("encode_vocabulary", f"""with {VOCAB_SQL},
t as (select doc_id, unnest(range(len(toks))) pos, unnest(toks) token
      from (select doc_id, {S.tokens('text')}[1:{MAX_LEN - 2}] toks from documents)),
k as (select doc_id, list(coalesce(id, {FE.FIRST_TOKEN_ID}) order by pos) ids, count(*) filter (where id is null) n_unknown
      from t left join vocab using (token) group by doc_id),
e as (select d.doc_id, list_concat([{FE.CLS_ID}::bigint], coalesce(ids, []::bigint[]), [{FE.SEP_ID}::bigint]) ids,
        coalesce(n_unknown, 0) n_unknown from documents d left join k using (doc_id))
select doc_id, md5(array_to_string(list_concat(ids, list_transform(range({MAX_LEN} - len(ids)), lambda x: {FE.PAD_ID}::bigint)), ',')) h,
  cast(len(ids) as bigint) n_mask, cast(n_unknown as bigint) n_unknown from e""")
def q_encode_vocabulary(spark, sf):
    """All documents encoded with the vocabulary that the training part taught."""
    d = FE.encode_learned(text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text", vocabulary(spark, sf), MAX_LEN)
    mask = FE.attention_mask(F.col("ids"))
    return d.select("doc_id", F.md5(join_numbers(F.col("ids"))).alias("h"),
                    F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mask"),
                    F.size(F.filter("ids", lambda x: x == FE.FIRST_TOKEN_ID)).cast("bigint").alias("n_unknown"))
