"""Zero-shot prompt / answer / text-mapping queries and the experiment grid."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from textlab.operators import ledger as LG
from textlab.operators.zeroshot import (LEXICON, LEXICON_LABELS, PROMPT_TEMPLATE, answer_loop, map_text,
                                        prompt_column, scorer_predict)
from textlab.plans import sqlfrag as S
from textlab.plans.registry import query, table, text_table
from textlab.session import scratch_dir

# --- fixed values: model codes of the experiment grid and their batch sizes ---
MODELS = ["ROB-BASE", "ROB-LRG", "DEB-V3", "ELE-LRG", "XLNET-LRG"]
SMALL_BATCH_MODEL, SMALL_BATCH, BATCH = "DEB-V3", 2, 4
GRID_SEEDS = [1234, 3456, 5678]
LANG_TAG = "en"
TRANSLATE_LANGS = ["de", "fr"]
UNTRANSLATABLE = "###"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


PROMPT_SQL = (f"{_sql_str(PROMPT_TEMPLATE)} || text || chr(10) || chr(10) || 'Labels: "
              + ", ".join(f"''{x}''" for x in LEXICON_LABELS) + "' || chr(10) || chr(10) || 'Answer: '")


@query("prompt_render", f"""with p as (select doc_id, {PROMPT_SQL} prompt from documents)
select doc_id, md5(prompt) h, cast(length(prompt) as bigint) n from p""")
def q_prompt_render(spark, sf):
    d = text_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", prompt_column("text").alias("prompt"))
    return d.select("doc_id", F.md5("prompt").alias("h"), F.length("prompt").cast("bigint").alias("n"))


def stub_answer(prompts: pd.Series, attempt: int) -> pd.Series:
    """Deterministic stand-in for a remote model, by the prompt's digest: on the first attempt one in five prompts
    gets an unusable answer, others a quoted label; the second attempt always answers a bare label."""
    v = prompts.map(lambda p: int(hashlib.md5(p.encode()).hexdigest()[:8], 16))
    if attempt == 1:
        return ("'" + (v % 4).map(dict(enumerate(LEXICON_LABELS))) + "'").where(v % 5 != 0, "maybe")
    return (v // 7 % 4).map(dict(enumerate(LEXICON_LABELS)))


ANSWER_SQL = f"""with p as (select doc_id, {PROMPT_SQL} prompt from documents),
v as (select doc_id, cast('0x' || substr(md5(prompt), 1, 8) as bigint) v from p),
a as (select doc_id, case when v % 5 = 0 then {LEXICON_LABELS}[(v // 7) % 4 + 1]
                          else chr(39) || {LEXICON_LABELS}[v % 4 + 1] || chr(39) end answer,
        case when v % 5 = 0 then 2 else 1 end attempts from v)
select doc_id, answer, cast(list_position({LEXICON_LABELS}, replace(answer, chr(39), '')) - 1 as int) y_pred,
  cast(attempts as int) attempts from a"""


def prompts(spark, sf):
    return text_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", prompt_column("text").alias("prompt"))


@query("answer_parse", ANSWER_SQL)
def q_answer_parse(spark, sf):
    out = answer_loop(prompts(spark, sf), "prompt", stub_answer, LEXICON_LABELS, max_attempts=3)
    return out.select("doc_id", "answer", "y_pred", "attempts")


@query("answer_ledger", ANSWER_SQL)
def q_answer_ledger(spark, sf):
    """The same answers by way of a stored ledger: each distinct prompt is asked once, in waves."""
    d, ledger = prompts(spark, sf), scratch_dir(spark, "ledger")
    LG.settle(d, "prompt", stub_answer, LEXICON_LABELS, ledger, max_attempts=3)
    return LG.outcomes(d, "prompt", LEXICON_LABELS, ledger).select("doc_id", "answer", "y_pred", "attempts")


def load_stub_scorer(path: str):
    """A scorer from its shipped file (label -> words): hits by label; refuses texts with a marker."""
    with open(path, encoding="utf-8") as f:
        words = {label: set(own) for label, own in json.load(f).items()}

    def score(texts: pd.Series, labels: list[str]) -> list[list[float]]:
        if texts.str.contains(UNTRANSLATABLE, regex=False).any():
            raise ValueError("the scorer refuses this text")
        tokens = texts.map(lambda t: re.findall(r"[^\W\d_]+", t.lower()))
        return [[sum(w in words[label] for w in own) for label in labels] for own in tokens]

    return score


@query("scorer_predict", f"""with tok as (select doc_id, unnest({S.tokens('text')}) token from documents),
hits as (select t.doc_id, lex.idx, count(*) c from tok t join {S.lexicon_values(LEXICON, LEXICON_LABELS)} using (token) group by all),
best as (select doc_id, first(idx order by c desc, idx) idx, sum(c) total from hits group by doc_id)
select d.doc_id, coalesce(contains(text, '{UNTRANSLATABLE}'), true) failed,
  case when not coalesce(contains(text, '{UNTRANSLATABLE}'), true) then {S.label_list(LEXICON_LABELS)}[coalesce(b.idx, 0) + 1] end y_pred,
  case when not coalesce(contains(text, '{UNTRANSLATABLE}'), true) then cast(coalesce(b.total, 0) as double) end total
from documents d left join best b using (doc_id)""")
def q_scorer_predict(spark, sf):
    """A user's scorer with its model file, shipped to the workers; rows that it refuses stand alone."""
    path = scratch_dir(spark, "scorer")
    spark.createDataFrame([(json.dumps(LEXICON),)], "value string").coalesce(1).write.text(path)
    d = text_table(spark, sf, "documents", ["doc_id", "text"])
    out = scorer_predict(d, "text", LEXICON_LABELS, load_stub_scorer, model=spark.read.text(path).inputFiles()[0])
    return out.select("doc_id", F.col("error").isNotNull().alias("failed"), "y_pred",
                      F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


def stub_translate(texts: pd.Series) -> pd.Series:
    """Stand-in for a translation service: tags the text; refuses texts with a marker."""
    if texts.str.contains(UNTRANSLATABLE, regex=False).any():
        raise ValueError("the service refuses this text")
    return "T:" + texts


@query("map_text_fallback", f"""select doc_id, md5(case when lang in ({', '.join(repr(x) for x in TRANSLATE_LANGS)})
    then (case when text is null or contains(text, '{UNTRANSLATABLE}') then '' else 'T:' || text end) else text end) h
from documents""")
def q_map_text_fallback(spark, sf):
    d = text_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    out = map_text(d, "text", stub_translate, select=F.col("lang").isin(TRANSLATE_LANGS), fallback="")
    return out.select("doc_id", F.md5("text_out").alias("h"))


@query("experiment_grid", f"""select concat_ws('-', lang, m.model, '{LANG_TAG}') run_id, lang dataset, m.model,
  s.seed, case when m.model = '{SMALL_BATCH_MODEL}' then {SMALL_BATCH} else {BATCH} end batch
from (select distinct lang from documents) d, (values {', '.join(f"('{m}')" for m in MODELS)}) m(model),
  (values {', '.join(f'({s})' for s in GRID_SEEDS)}) s(seed)""")
def q_experiment_grid(spark, sf, custom_model: str | None = None, custom_for: str = MODELS[0]):
    """Datasets (from the data) x models x seeds as rows, via generators.

    A custom model name stands in the run id for the one model code ``custom_for``."""
    ds = table(spark, sf, "documents").select(F.col("lang").alias("dataset")).distinct()
    g = ds.select("dataset", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")) \
          .select("dataset", "model", F.explode(F.array(*[F.lit(s) for s in GRID_SEEDS])).alias("seed"))
    name = F.when(F.lit(custom_model).isNotNull() & (F.col("model") == custom_for), F.lit(custom_model)) \
        .otherwise(F.col("model"))
    return g.select(F.concat_ws("-", "dataset", name, F.lit(LANG_TAG)).alias("run_id"), "dataset", "model", "seed",
                    F.when(F.col("model") == SMALL_BATCH_MODEL, SMALL_BATCH).otherwise(BATCH).alias("batch"))
