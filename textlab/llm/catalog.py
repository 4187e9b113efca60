"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm import (alignment, bpe, chat, classifier, fingerprints, licenses, lm_scores, merkle, near_dups, packing,
                         quality_rules, secrets, token_files)
from textlab.llm.common import table
from textlab.session import scratch_dir

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of both."""
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id and size of its class of copies and near copies."""
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and score of every text."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


#: A conversation of control strings alone.
TRICKY = "</s>[INST] ok [/INST]"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the tricky one, formatted and read back."""
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_chats(rows)).drop("kept")


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = f"""
with own as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{TRICKY}' union all select -7, 1, 'assistant', '{TRICKY}'),
lengths as (select *, length(replace({_escaped_sql("role")}, chr(10), 'nn')) + length({_escaped_sql("text")}) + 24 as n
  from own)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), ''))
    as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from lengths group by conv_id
"""


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by how much more it resembles the documents labelled good than all documents."""
    return lm_scores.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= classifier.GOOD).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every text."""
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, held against each other and the next document's."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text: counts, the base spans' digest, and all of them as one string."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "novel")

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens under two tokenizers, aligned, with corpus-wide counts of linked ids."""
    return alignment.score(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its source's root, the root, and its proof."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    def own(value: str) -> str:
        return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"

    return "sha256(" + " || ".join(map(own, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Relations of the trees over ``leaves`` (tree, pos, h): {name}{level}, {name}_root (tree, h) and, for each leaf,
    {name}_path (tree, pos, steps), the (left, right) siblings level by level."""
    out = [f"{name}0 as (select tree, pos, h, count(*) over (partition by tree) as n from {leaves})"]
    for k in range(1, levels + 1):
        # a tree that has come to one node stays as it is
        out.append(f"""{name}{k} as materialized (select tree, pos // 16 as pos,
  case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h,
  (any_value(n) + 15) // 16 as n, any_value(n) > 1 as inner_node, list(h order by pos) as run from {name}{k - 1} group by tree, pos // 16)""")
    out.append(f"{name}_root as (select tree, h from {name}{levels})")
    steps, joins = [], []
    for k in range(1, levels + 1):
        joins.append(f"join {name}{k} r{k} on r{k}.tree is not distinct from x.tree and r{k}.pos = x.pos // {16 ** k}")
        place = f"(x.pos // {16 ** (k - 1)}) % 16"
        steps.append(f"""case when r{k}.inner_node then [struct_pack(l := array_to_string(r{k}.run[1:{place}], ''),
  r := array_to_string(r{k}.run[{place} + 2:], ''))] else [] end""")
    out.append(f"{name}_path as (select x.tree, x.pos, {' || '.join(steps)} as steps from {name}0 x {' '.join(joins)})")
    return ",\n".join(out)


#: Unsigned crc32 of a decimal number, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::ubigint,
  list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::ubigint)),
    lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1)))))"""

#: Trees of up to 16**6 documents a source and 16**4 sources.
OP12_SQL = f"""
with own as (select doc_id, source as tree, {_leaf_sql("text")} as h,
    case when {_CRC_SQL} % 5 = 0 then
      {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as t from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, h, t) - 1 as pos from own),
{_tree_sql("s", "leaves", 6)},
subroots as (select 0 as tree, tree as source, h, row_number() over (order by tree nulls first) - 1 as pos from s_root),
{_tree_sql("u", "subroots", 4)},
whole as (select l.doc_id, l.h as leaf, b.h as subroot, r.h as root, coalesce(l.t, l.h) as held, p.steps || q.steps as steps
  from leaves l join s_path p on p.tree is not distinct from l.tree and p.pos = l.pos
  join subroots b on b.source is not distinct from l.tree join u_path q on q.pos = b.pos, u_root r),
folded as (select *, list_reduce(list_prepend(held, list_transform(steps, lambda s: s.l || '|' || s.r)),
    lambda x, s: sha256(string_split(s, '|')[1] || x || string_split(s, '|')[2])) as folded_root from whole)
select doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to files in the shared folder, and read back from them."""
    out = scratch_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), out)
    return token_files.read_digest(spark, out)


OPERATORS = (op1_bpe, op2_near_dups, op3_licenses, op4_chat, op5_lm_scores, op6_classifier, op7_packing,
             op8_quality_rules, op9_fingerprints, op10_secrets, op11_alignment, op12_merkle, op13_token_files)


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op12_merkle": OP12_SQL}
