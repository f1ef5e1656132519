"""Run registered queries against their SQL text on the same parquet files.

    python tests/oracle.py --sf sf0.01 [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("quantgrid-tests")
             .config("spark.sql.shuffle.partitions", os.environ.get("TEST_SHUFFLE", "8")).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def _plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return f"{bad} in the plan", len(rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    ocols, orows = canonical(names, cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}", len(rows)
    if len(rows) != len(orows):
        return f"rows {len(rows)} != {len(orows)}", len(rows)
    if not rows:
        return "no rows at all", 0
    bad = [(a, b) for a, b in zip(rows, orows) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g.\n      spark {bad[0][0]}\n      sql   {bad[0][1]}", len(rows)
    return None, len(rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("--skip", type=int, default=0)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    spark = session()
    sf_dir = f"/root/testdata/{a.sf}"
    con = connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    failed = []
    for n in names[a.skip:]:
        t = time.time()
        try:
            if n in sql:
                err, rows = compare(spark, con, sf_dir, qs[n], sql[n])
            else:
                rows = qs[n](spark, sf_dir).count()
                err = None if rows else "no rows at all"
        except Exception as ex:  # report every failing query, not only the first
            err, rows = f"{type(ex).__name__}: {str(ex)[:500]}", -1
        mark = "ok  " if err is None else "FAIL"
        print(f"{mark} {n} rows={rows} {time.time() - t:.1f}s {'' if n in sql else '(rows only)'}{err or ''}", flush=True)
        if err:
            failed.append(n)
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
