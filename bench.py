"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to completion with the ``noop`` sink (full
computation, nothing collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "zero_shot_report", "classification_report", "seeds_summary", "confusion_ovr", "majority_baseline",
    "vote_keep_ties", "vote_neutral", "clean_tweet", "normalise_ws", "concat_context", "dup_audit",
    "shuffle", "holdout", "split_train_val", "resample_up", "subset_sizes",
    "label_inverse", "weighted_ce", "encode_pad_mask", "truncation_audit",
    "nb_train", "nb_predict", "auto_label", "learning_curve", "regression_report", "src_labelled_lines",
    "log_attempts", "best_epoch", "src_csv_project", "stack_seeds", "sink_publish", "answer_parse",
    "map_text_fallback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from textlab.plans import catalog
    from textlab.session import get_spark

    spark = get_spark("textlab-bench", cpus=cpus)
    qs = catalog.queries()
    qs["zero_shot_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for k in keys:
        t0 = time.perf_counter()
        qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir,
                      "cpus": int(cpus), "n_queries": len(times)}))


if __name__ == "__main__":
    main()
