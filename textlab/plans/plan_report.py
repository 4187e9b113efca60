"""Summarise the physical plan of every registered query.

Usage: python -m textlab.plans.plan_report [sf_dir] > PLANS.md
Per key: shuffles (Exchange), join strategies, Python nodes, and for
each Parquet scan the pruned ReadSchema and pushed filters.  Queries that
write files or fit models run their eager parts while being planned.
"""

from __future__ import annotations

import re
import sys


def summarise(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                                  r"CartesianProduct)\s*(\w+)?", plan)))
    scans = []
    for m in re.finditer(r"\(\d+\) Scan parquet\s*\n(.*?)(?=\n\n)", formatted, re.S):
        block = m.group(1)
        rs = re.search(r"ReadSchema: (.*)", block)
        pf = re.search(r"PushedFilters: (.*)", block)
        loc = re.search(r"Location: \w+ \[(.*?)\]", block)
        scans.append((loc.group(1).rsplit("/", 1)[-1] if loc else "?", rs.group(1) if rs else "",
                      pf.group(1) if pf and pf.group(1) != "[]" else ""))
    py = sorted(set(re.findall(r"(MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas)", plan)))
    return {"exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
            + plan.count("Exchange RoundRobinPartitioning") + plan.count("Exchange SinglePartition"),
            "broadcasts": plan.count("BroadcastExchange"), "joins": [" ".join(j).strip() for j in joins],
            "python": py, "scans": sorted(set(scans)), "codegen_stages": plan.count("*(")}


def main(argv):
    from textlab.plans import catalog
    from textlab.session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = get_spark("plan-report")
    print(f"# Physical plan summary ({sf_dir})\n")
    print("Generated by `python -m textlab.plans.plan_report`. Initial AQE plans (runtime re-planning may turn "
          "sort-merge joins into broadcasts when a side turns out small).\n")
    print("| key | shuffles | broadcasts | joins | python | scans (file: ReadSchema; pushed filters) |")
    print("|---|---|---|---|---|---|")
    for key, fn in sorted(catalog.queries().items()):
        try:
            s = summarise(fn(spark, sf_dir))
        except Exception as exc:  # report and go on
            print(f"| {key} | error: {type(exc).__name__} | | | | |")
            continue
        scans = "<br>".join(f"{f}: `{r}`" + (f" {p}" if p else "") for f, r, p in s["scans"])
        print(f"| {key} | {s['exchanges']} | {s['broadcasts']} | {', '.join(s['joins']) or '-'} | "
              f"{', '.join(s['python']) or '-'} | {scans} |")


if __name__ == "__main__":
    main(sys.argv[1:])
