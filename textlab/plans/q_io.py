"""Source / sink queries. Files go to a fresh folder under the session's
shared checkpoint root (never a machine-local temp dir on a cluster)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.plans import sqlfrag as S
from textlab.plans.q_eval import RUN_CELLS_SQL, RUNS_SQL, SUMMARY_SQL, report_runs, runs
from textlab.plans.registry import query, table, text_table
from textlab.session import scratch_dir
from textlab.sources import io as IO
from textlab.sources import published as PB
from textlab.functions.text import NA_TOKENS, WS


@query("src_text_lines", """select doc_id, cast(unnest(range(len(parts))) as bigint) line_no, unnest(parts) line
from (select doc_id, string_split(text, chr(10)) parts from documents)""")
def q_src_text_lines(spark, sf):
    return IO.split_lines(text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")


_NA_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


@query("src_labelled_lines", f"""with l as (
  select doc_id, cast(unnest(range(len(parts))) as bigint) line_no, unnest(parts) line
  from (select doc_id, string_split(text, chr(10)) parts from documents)),
s as (select doc_id, line_no, regexp_replace(line, '^{S.WS}+|{S.WS}+$', '', 'g') line from l)
select doc_id, line_no, case when line in ({_NA_SQL}) then null else line end line from s where line <> ''""")
def q_src_labelled_lines(spark, sf):
    return IO.labelled_lines(IO.split_lines(text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text"))


def text_files(spark, sf):
    """The documents' texts as text files in the shared folder."""
    path = scratch_dir(spark, "lines")
    d = text_table(spark, sf, "documents", ["text"]).where(F.col("text").isNotNull())
    d.write.option("lineSep", "\n").text(path)
    return path


@query("src_line_files", """select md5(line) h, cast(count(*) as bigint) n
from (select unnest(string_split(text, chr(10))) line from documents) group by 1""")
def q_src_line_files(spark, sf):
    lines = IO.read_line_files(spark, text_files(spark, sf))
    return lines.groupBy(F.md5("line").alias("h")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("src_labelled_files", f"""with l as (select unnest(string_split(text, chr(10))) line from documents),
s as (select regexp_replace(line, '^{S.WS}+|{S.WS}+$', '', 'g') line from l),
v as (select md5(case when line in ({_NA_SQL}) then null else line end) h from s where line <> '')
select h, cast(count(*) as bigint) n from v group by h""")
def q_src_labelled_files(spark, sf):
    lines = IO.labelled_lines(IO.read_line_files(spark, text_files(spark, sf)))
    return lines.groupBy(F.md5("line").alias("h")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("src_labels", "select doc_id, quality label from labels")
def q_src_labels(spark, sf):
    path = scratch_dir(spark, "labels")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("float"))
    IO.write_csv(lab, path, header=False)
    return IO.read_labels(spark, path, "doc_id BIGINT, label FLOAT").select("doc_id", "label")


@query("src_csv_project", "select doc_id, md5(text) h, lang from documents")
def q_src_csv_project(spark, sf):
    path = scratch_dir(spark, "csv")
    IO.write_csv(table(spark, sf, "documents"), path)
    back = IO.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
                       ["doc_id", "text", "lang"])
    return back.select("doc_id", F.md5("text").alias("h"), "lang")


@query("src_tsv", "select conv_id, turn, role, md5(text) h from conversations")
def q_src_tsv(spark, sf):
    path = scratch_dir(spark, "tsv")
    IO.write_csv(table(spark, sf, "conversations"), path, sep="\t")
    back = IO.read_csv(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING", sep="\t")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("h"))


@query("align_pairs", """select count(*) filter (where d.doc_id is not null and l.doc_id is not null) n_both,
  count(*) filter (where l.doc_id is null) n_text_only, count(*) filter (where d.doc_id is null) n_label_only
from documents d full outer join labels l using (doc_id)""")
def q_align_pairs(spark, sf):
    return IO.align_keyed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


PRED_COLS = "doc_id BIGINT, y_pred INT"


@query("stack_seeds", f"with {RUNS_SQL} select run_id, seed, doc_id, y_pred from runs")
def q_stack_seeds(spark, sf):
    """Predictions in a folder a run and seed, read back as one table; run and seed are partition columns."""
    path = scratch_dir(spark, "preds")
    IO.write_partitioned(runs(spark, sf).select("run_id", "seed", "doc_id", "y_pred"), path, ["run_id", "seed"],
                         mode="overwrite", fmt="csv")
    return IO.read_partitions(spark, path, PRED_COLS, "run_id STRING, seed INT")


@query("stack_indexed", f"with {RUNS_SQL} select run_id, seed, doc_id, y_pred from runs where seed <> 3456")
def q_stack_indexed(spark, sf):
    """The same from a layout that only names files: an index of the names, filtered, decides what is read."""
    path = scratch_dir(spark, "named")
    r = runs(spark, sf).withColumn("of", F.concat_ws("__", "run_id", "seed"))
    IO.write_partitioned(r.select("doc_id", "y_pred", "of"), path, ["of"], mode="overwrite", fmt="csv")
    index = IO.file_index(spark, path, r"of=(.+)__(\d+)/", {"run_id": 1, "seed": 2}).where("run_id <> '' and seed <> '3456'")
    back = IO.read_indexed(index.withColumn("seed", F.col("seed").cast("int")), PRED_COLS)
    return back.select("run_id", "seed", "doc_id", "y_pred")


@query("align_files", f"""with l as (select d.doc_id, replace(regexp_replace(text, '{S.WS}+', ' ', 'g'), '---', '') line, quality label
  from documents d join labels l using (doc_id))
select cast(row_number() over (order by doc_id) - 1 as bigint) "at", md5(line) h, cast(label as int) label from l""")
def q_align_files(spark, sf):
    """Texts in three files and labels in four, paired by place."""
    both = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(
        text_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id")
    line = F.replace(F.regexp_replace("text", f"{WS}+", " "), F.lit("---"), F.lit(""))
    x, y = scratch_dir(spark, "x"), scratch_dir(spark, "y")
    both.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(line).write.option("lineSep", "\n").text(x)
    labels = both.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(F.col("label").cast("float"))
    IO.write_csv(labels, y, header=False)
    paired = IO.pair_files(IO.read_lines_at(spark, x), IO.with_file_positions(IO.read_labels(spark, y)))
    return paired.select("at", F.md5("line").alias("h"), "label")


@query("sink_summary_text", f"""{SUMMARY_SQL}
select run_id, cast(case metric when 'accuracy' then 0 when 'precision' then 1 when 'recall' then 2 when 'f1_macro' then 3 else 4 end
    as bigint) line_no,
  case metric when 'accuracy' then 'accuracy' when 'precision' then 'precision' when 'recall' then 'recall'
              when 'f1_macro' then 'f1 score macro' else 'f1 score weighted' end
    || ': ' || cast(mean as varchar) || ' +/- ' || cast(std as varchar) line from summ""")
def q_sink_summary_text(spark, sf):
    """The five-line summaries written as text files, one a run, and read back with their line numbers."""
    path = scratch_dir(spark, "summaries")
    lines = M.seeds_summary_text(M.seeds_summary(report_runs(spark, sf, None), ["run_id"]), ["run_id"])
    IO.write_lines(lines, path, "run_id", "line_no")
    back = spark.read.option("lineSep", "\n").schema("value STRING, run_id STRING").text(path)
    placed, _ = IO.with_file_positions(back.withColumnRenamed("value", "line"))
    return placed.select("run_id", F.col("pos").alias("line_no"), "line")


@query("sink_corpus", """select l.doc_id, l.quality label, md5(d.text) h from labels l join documents d using (doc_id)""")
def q_sink_corpus(spark, sf):
    path = scratch_dir(spark, "corpus")
    c = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")) \
        .join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    c.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("doc_id", "label", F.md5("text").alias("h"))


@query("sink_metric_log", f"""with {RUNS_SQL}, {RUN_CELLS_SQL}
select r.*, 'test' part, a.attempt_id from {S.report('cells', ['run_id', 'seed'])} r,
  (values (0), (1)) a(attempt_id)""")
def q_sink_metric_log(spark, sf):
    """Append-only metric log: two attempts appended, partitioned by (part, run)."""
    path = scratch_dir(spark, "metric-log")
    rep = M.classification_report(runs(spark, sf), ["run_id", "seed"]).withColumn("part", F.lit("test"))
    for attempt in (0, 1):
        IO.write_partitioned(rep.withColumn("attempt_id", F.lit(attempt)), path, ["part", "run_id"], mode="append")
    back = spark.read.parquet(path)
    return back.select("run_id", "seed", "n", *M.METRICS, "part", "attempt_id")


@query("sink_predictions", f"""with {RUNS_SQL}
select run_id, seed, doc_id, printf('%.6f', cast(y_pred as double)) y_pred from runs""")
def q_sink_predictions(spark, sf):
    path = scratch_dir(spark, "pred-export")
    out = runs(spark, sf).select("run_id", "seed", "doc_id", IO.format_fixed("y_pred").alias("y_pred"))
    IO.write_csv(out.sortWithinPartitions("run_id", "seed", "doc_id"), path)
    return IO.read_csv(spark, path, "run_id STRING, seed INT, doc_id BIGINT, y_pred STRING", multi_line=False)


@query("sink_overwrite_seed", f"""with {RUNS_SQL}
select run_id, seed, doc_id, case when seed = 1234 then y_true else y_pred end y_pred from runs""")
def q_sink_overwrite_seed(spark, sf):
    """Re-running one seed replaces only that seed's partitions."""
    path = scratch_dir(spark, "runs")
    r = runs(spark, sf)
    IO.write_partitioned(r.select("doc_id", "y_pred", "run_id", "seed"), path, ["run_id", "seed"], mode="overwrite")
    rerun = r.where(F.col("seed") == 1234).select("doc_id", F.col("y_true").alias("y_pred"), "run_id", "seed")
    IO.write_partitioned(rerun, path, ["run_id", "seed"], mode="overwrite")
    back = spark.read.parquet(path)
    return back.select("run_id", F.col("seed").cast("int").alias("seed"), "doc_id", "y_pred")


@query("sink_publish", f"""with {RUNS_SQL}
select run_id, seed, doc_id, case when run_id = 'quality' then y_true else y_pred end y_pred from runs""")
def q_sink_publish(spark, sf):
    """Published are all runs; a new 'quality' run is staged, then committed in place of the old one."""
    root, cols = scratch_dir(spark, "published"), ["run_id", "seed"]
    r = runs(spark, sf).select("doc_id", "y_pred", "y_true", *cols)
    PB.commit(spark, root, PB.stage(r.drop("y_true"), root, cols), cols)
    rerun = r.where(F.col("run_id") == "quality").select("doc_id", F.col("y_true").alias("y_pred"), *cols)
    PB.commit(spark, root, PB.stage(rerun, root, cols), cols)
    return PB.read(spark, root, "doc_id LONG, y_pred INT, run_id STRING, seed INT").select("run_id", "seed", "doc_id", "y_pred")
