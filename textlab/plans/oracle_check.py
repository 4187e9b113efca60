"""Local stand-in for the correctness gate: Spark query vs DuckDB oracle.

Usage: python -m textlab.plans.oracle_check [sf_dir] [key ...]
Compares column names, row counts and the multiset of row values.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_pdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(s_pdf), "spark_s": round(t1 - t0, 2)}
    o_pdf = con.sql(sql).df()
    t2 = time.time()
    sc, sr = rows_of(s_pdf)
    oc, orows = rows_of(o_pdf)
    res = {"key": key, "rows": len(sr), "oracle_rows": len(orows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sc != oc:
        res.update(status="COLUMNS", spark_cols=sc, oracle_cols=oc)
    elif sr != orows:
        diff_s = [r for r in sr if r not in set(orows)][:3]
        diff_o = [r for r in orows if r not in set(sr)][:3]
        res.update(status="VALUES", spark_only=diff_s, oracle_only=diff_o)
    else:
        res["status"] = "OK"
    res["types"] = {c: (str(sdf.schema[c].dataType.simpleString()), str(o_pdf[c].dtype)) for c in sc if c in o_pdf}
    return res


def main(argv):
    from textlab.plans import catalog
    from textlab.session import get_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or sorted(catalog.queries())
    spark = get_spark("oracle-check")
    con = duck(sf_dir)
    qs, os_ = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as exc:  # report and go on
            r = {"key": k, "status": "ERROR", "error": repr(exc)[:800]}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys)} keys, {bad} not OK")


if __name__ == "__main__":
    main(sys.argv[1:])
