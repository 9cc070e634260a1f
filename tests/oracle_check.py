"""Run registered queries in Spark and their SQL in DuckDB, compare row by row.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""
from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pixtables")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(i) for i in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", "") for x in r))


def compare(name, df, sql, con):
    rows = df.collect()
    sc, sr = table_rows(df.columns, rows)
    if sql is None:
        return f"rows-only {len(sr)}"
    cur = con.execute(sql)
    dc, dr = table_rows([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        raise AssertionError(f"columns {sc} != {dc}")
    if len(sr) != len(dr):
        raise AssertionError(f"rows {len(sr)} != {len(dr)}; {sr[:2]} {dr[:2]}")
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        raise AssertionError(f"{len(bad)}/{len(sr)} rows differ {sc}\n  {bad[0][0]}\n  {bad[0][1]}")
    types = [(a, b) for a, b in zip(sr[:1], dr[:1]) if [type(x) for x in a] != [type(x) for x in b]]
    return f"ok {len(sr)}" + (f" TYPES {types}" if types else "") + (" EMPTY" if not sr else "")


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--skip", default="")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as e

    sf = f"/root/testdata/sf{a.sf}"
    qs, os_ = e.queries(), e.oracle_sql()
    spark, con = session(), duck(sf)
    names = [n for n in qs if not a.names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in a.names)]
    fails = 0
    for n in names:
        t = time.time()
        try:
            spark.catalog.clearCache()
            msg = compare(n, qs[n](spark, sf), os_.get(n), con)
        except Exception as ex:
            fails += 1
            msg = "FAIL " + str(ex)[:1500]
            if not isinstance(ex, AssertionError):
                tb = traceback.format_exc().splitlines()
                msg += "\n" + "\n".join(l for l in tb if "pixtables" in l)[-600:]
        print(f"{n:32s} {time.time()-t:6.1f}s  {msg}", flush=True)
    print(f"{len(names)} queries, {fails} failed")
    sys.exit(1 if fails else 0)


if __name__ == "__main__":
    main()
