"""The README's replication workflow, end to end on the test tables."""

from pyspark.sql import functions as F

from textlab.functions.text import clean_tweet
from textlab.operators import metrics as M
from textlab.operators import models as MD
from textlab.operators import prep as P
from textlab.operators import sampling as SM

SF = "/root/testdata/sf0.01"


def test_replication_workflow(spark):
    raw = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    votes = raw.select(clean_tweet("text").alias("text"), "doc_id", F.col("quality").alias("stance"))
    corpus = P.vote_drop_ties(votes, ["doc_id", "text"], "stance")
    b = SM.holdout(corpus, 1234, "doc_id", 200)
    a = SM.complement(corpus, b, "doc_id")
    runs = []
    for seed in (1234, 3456, 5678):
        tr = SM.resample(a, seed, "doc_id", "label", "upsampling")
        model = MD.nb_train(tr, "text", "label")
        runs.append(MD.nb_predict(model, b, "doc_id", "text").withColumn("seed", F.lit(seed)))
    pred = runs[0].unionByName(runs[1]).unionByName(runs[2]).join(b.select("doc_id", "label"), "doc_id")
    report = M.classification_report(pred, ["seed"], "label", "y_pred", digits=None)
    assert report.count() == 3 and report.where("n = 200").count() == 3
    lines = M.seeds_summary_text(M.seeds_summary(report.withColumn("run", F.lit("nb")), ["run"]), ["run"])
    text = [r.line for r in lines.orderBy("line_no").collect()]
    assert [t.split(":")[0] for t in text] == ["accuracy", "precision", "recall", "f1 score macro",
                                               "f1 score weighted"]
