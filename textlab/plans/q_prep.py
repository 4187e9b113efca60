"""Preparation queries: filters, recodes, votes, text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators import prep as P
from textlab.operators.windows import lag_lead
from textlab.plans import sqlfrag as S
from textlab.plans.registry import query, table, text_table

# --- fixed values: recode maps of the fixtures ---
EVENT_POLARITY = {1: ["purchase"], 0: ["view", "click", "signup"], -1: ["error"]}


@query("flt_equal", "select doc_id, source from documents where lang = 'en'")
def q_flt_equal(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id", "source")


@query("flt_notnull", """select d.doc_id, l.quality from documents d left join labels l using (doc_id)
where l.quality is not null""")
def q_flt_notnull(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").where(P.not_missing("quality")).select("doc_id", "quality")


@query("flt_band", "select p_partkey, p_size from part where p_size >= 30 or p_size < 20")
def q_flt_band(spark, sf):
    return table(spark, sf, "part").where(P.band_filter("p_size", 20, 30)).select("p_partkey", "p_size")


@query("threshold_label", """select p_partkey, case when p_size >= 30 then 1 else 0 end label
from part where p_size >= 30 or p_size < 20""")
def q_threshold_label(spark, sf):
    p = table(spark, sf, "part").where(P.band_filter("p_size", 20, 30))
    return p.select("p_partkey", P.threshold_label("p_size", 30).alias("label"))


@query("recode_isin", """select event_id, case when event_type = 'purchase' then 1
  when event_type in ('view', 'click', 'signup') then 0 when event_type = 'error' then -1 else 99 end v from events""")
def q_recode_isin(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", P.recode_map("event_type", EVENT_POLARITY, F.lit(99)).alias("v"))


@query("recode_override", """with o as (select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) num,
  case o_orderstatus when 'P' then 1 when 'O' then 2 end k from orders)
select o_orderkey, case when k in (1, 2) then 1 when num = 1 then 0 when num = 2 then 1
  when num in (3, 4) then 2 else num end code from o""")
def q_recode_override(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("num"),
        F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).alias("k"))
    return o.select("o_orderkey", P.recode_override("num", "k").alias("code"))


def votes(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.col("ts").cast("date").cast("string").alias("vday"), "event_type")


VOTE_SQL = """v as (select user_id, cast(cast(ts as date) as varchar) vday, event_type v from events),
c as (select user_id, vday, v, count(*) n from v where user_id is not null and vday is not null group by all),
t as (select user_id, vday, max(n) filter (where v is not null) top,
        cast(coalesce(sum(n) filter (where v is not null), 0) as bigint) n_votes from c group by all),
m as (select t.user_id, t.vday, coalesce(string_agg(c.v, '|' order by c.v) filter (where c.n = t.top), '') modes,
        cast(count(*) filter (where c.n = t.top) as bigint) n_modes, t.n_votes
      from t join c using (user_id, vday) group by all)"""


@query("vote_keep_ties", f"with {VOTE_SQL} select * from m")
def q_vote_keep_ties(spark, sf):
    m = P.vote_keep_ties(votes(spark, sf), ["user_id", "vday"], "event_type")
    return m.select("user_id", "vday", P.flatten_modes().alias("modes"), F.col("n_modes").cast("bigint"), "n_votes")


@query("vote_drop_ties", f"with {VOTE_SQL} select user_id, vday, modes label from m where n_modes = 1")
def q_vote_drop_ties(spark, sf):
    return P.vote_drop_ties(votes(spark, sf), ["user_id", "vday"], "event_type")


@query("vote_neutral", """with v as (select user_id, cast(cast(ts as date) as varchar) vday,
    case when event_type = 'purchase' then 1 when event_type in ('view', 'click', 'signup') then 0
         when event_type = 'error' then -1 else 99 end v from events),
c as (select user_id, vday, v, count(*) n from v group by all),
t as (select user_id, vday, max(n) top from c group by all),
m as (select user_id, vday, count(*) n_modes, min(v) v from c join t using (user_id, vday) where n = top group by all),
lab as (select user_id, vday, case when n_modes = 1 and v in (-1, 0, 1) then v else 0 end label from m)
select user_id, vday, case when label = -1 then 0 else label end label from lab where label <> 0""")
def q_vote_neutral(spark, sf):
    v = votes(spark, sf).select("user_id", "vday", P.recode_map("event_type", EVENT_POLARITY, F.lit(99)).alias("v"))
    return P.binary_from_polar(P.vote_neutral(v, ["user_id", "vday"], "v", codes=list(EVENT_POLARITY)))


@query("drop_first_group", f"""with {VOTE_SQL}
select user_id, vday, modes from m
where (user_id, vday) <> (select (user_id, vday) from m order by user_id, vday limit 1)""")
def q_drop_first_group(spark, sf):
    m = P.vote_keep_ties(votes(spark, sf), ["user_id", "vday"], "event_type")
    m = m.select("user_id", "vday", P.flatten_modes().alias("modes"))
    return P.drop_first_group(m, ["user_id", "vday"], positional=True)


@query("drop_empty_group", f"""with l as (select unnest(string_split(text, chr(10))) line from documents),
s as (select regexp_replace(line, '^{S.WS}+|{S.WS}+$', '', 'g') line from l)
select md5(line) h, cast(count(*) as bigint) n from s group by line having line <> ''""")
def q_drop_empty_group(spark, sf):
    """The lines' groups without that of the lines that cleaning leaves empty."""
    d = text_table(spark, sf, "documents", ["text"])
    lines = d.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(T.py_strip("line").alias("line"))
    groups = lines.groupBy("line").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return P.drop_first_group(groups, ["line"]).select(F.md5("line").alias("h"), "n")


_CLEAN_SQL = f"regexp_replace(replace(text, '---', ''), '{S.WS}{S.WS}+', ' ', 'g')"


def _by_text_sql(order: str, key: str, shown: str) -> str:
    return f"""select {order} clean_first, md5(any_value({shown})) h, any_value(v) filter (where n = top) label from (
  select *, max(n) over (partition by k) top from (
    select {key} k, v, any_value(text) text, count(*) n from x group by all))
group by k having count(*) filter (where n = top) = 1"""


@query("vote_by_text", f"""with x as (select lower(substr(text, 1, 3)) || text text, quality v from documents join labels using (doc_id)
  union all select '  ' || lower(substr(text, 1, 3)) || text, toxic from documents join labels using (doc_id)
  union all select ' --- ' || lower(substr(text, 1, 3)) || text, toxic from documents join labels using (doc_id))
{_by_text_sql('true', _CLEAN_SQL, _CLEAN_SQL)} union all {_by_text_sql('false', 'text', _CLEAN_SQL)}""")
def q_vote_by_text(spark, sf):
    """Votes by cleaned text, and by text as it is with cleaning afterwards.  Three raters see a text with different
    blanks and dashes, so only the first order makes them one group."""
    d = text_table(spark, sf, "documents", ["doc_id", "text"]).join(table(spark, sf, "labels"), "doc_id")
    own = F.concat(F.lower(F.substring("text", 1, 3)), "text")
    x = d.select(F.inline(F.array(*[F.struct(F.concat(F.lit(before), own).alias("text"), F.col(v).alias("v"))
                                    for before, v in (("", "quality"), ("  ", "toxic"), (" --- ", "toxic"))])))
    both = [P.vote_by_text(x, "text", "v", T.normalise_ws, first).select(
        F.lit(first).alias("clean_first"), F.md5("text").alias("h"), "label") for first in (True, False)]
    return both[0].unionByName(both[1])


def decorated(spark, sf):
    """Tweet-like text: retweet marker, handle, URL, double space, quotes."""
    d = text_table(spark, sf, "documents", ["doc_id", "lang", "source", "text"])
    return d.select("doc_id", F.concat(F.lit("RT @"), "lang", "source", F.lit(" see https://ex.co/p?d="),
                                       F.col("doc_id").cast("string"), F.lit('  "'), "text", F.lit('"')).alias("x"))


# --- fixed values: the URL and handle patterns of the cleaner, for DuckDB ---
URL_SQL = (r"https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
           r"(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)")
HANDLE_SQL = "@" + S.WORD + "{2,15}"


@query("clean_tweet", rf"""with recursive dec as (
  select doc_id, 'RT @' || lang || source || ' see https://ex.co/p?d=' || cast(doc_id as varchar) || '  "' || text || '"' x
  from documents),
s1 as (select doc_id, regexp_replace(replace(x, 'RT ', ''), '{URL_SQL}', '', 'g') x from dec),
fix(doc_id, x, it) as (
  select doc_id, x, 0 from s1
  union all
  select doc_id, regexp_replace(x, '{HANDLE_SQL}', '', 'g'), it + 1 from fix where regexp_matches(x, '{HANDLE_SQL}')),
s2 as (select doc_id, arg_max(x, it) x from fix group by doc_id),
s3 as (select doc_id, replace(regexp_replace(regexp_replace(x, '{S.WS}{S.WS}+', ' ', 'g'), '^{S.WS}', ''), '"', '') x
       from s2)
select doc_id, md5(x) h, cast(length(x) as bigint) n from s3""")
def q_clean_tweet(spark, sf):
    c = decorated(spark, sf).select("doc_id", T.clean_tweet("x").alias("x"))
    return c.select("doc_id", F.md5("x").alias("h"), F.length("x").cast("bigint").alias("n"))


@query("normalise_ws", f"""with s as (select conv_id, turn,
  regexp_replace(replace(text, '---', ''), '{S.WS}{S.WS}+', ' ', 'g') x from conversations)
select conv_id, turn, md5(x) h, cast(length(x) as bigint) n from s""")
def q_normalise_ws(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_ws("text").alias("x"))
    return c.select("conv_id", "turn", F.md5("x").alias("h"), F.length("x").cast("bigint").alias("n"))


@query("concat_context", """with s as (select conv_id, turn,
  coalesce(lag(text) over w, '') || ' ' || coalesce(text, '') || coalesce(lead(text) over w, '') x
  from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, md5(x) h, cast(length(x) as bigint) n from s""")
def q_concat_context(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nb = lag_lead(conv, ["conv_id"], "turn", "text", "before", "after")
    c = nb.select("conv_id", "turn", T.concat_context("before", "text", "after").alias("x"))
    return c.select("conv_id", "turn", F.md5("x").alias("h"), F.length("x").cast("bigint").alias("n"))
