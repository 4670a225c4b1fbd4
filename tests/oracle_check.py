"""Runs a registered query on Spark and its oracle on DuckDB and compares the rows as sorted values."""
from __future__ import annotations

import math
import sys
import time

import duckdb

from linewell.sources.views import BASE_TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    t = time.time()
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    compare.spark_seconds = time.time() - t
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (name, cols, sorted(names))
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    return got, want, cols


def main(names, sf_dir):
    from pyspark.sql import SparkSession

    from linewell import catalog
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.log.level", "ERROR").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = catalog.queries(), catalog.oracles()
    for n in names or q:
        t = time.time()
        try:
            if n in o:
                got, want, cols = compare(spark, con, n, q[n], o[n], sf_dir)
                ok = got == want
                print(f"{'OK ' if ok else 'BAD'} {n} rows={len(got)}/{len(want)} spark {compare.spark_seconds:.1f}s all {time.time() - t:.1f}s", flush=True)
                if not ok:
                    print("   ", cols)
                    gs, ws = set(got), set(want)
                    print("    only spark:", sorted(gs - ws)[:3])
                    print("    only duck: ", sorted(ws - gs)[:3], flush=True)
            else:
                rows = q[n](spark, sf_dir).collect()
                print(f"ROW {n} rows={len(rows)} {time.time() - t:.1f}s {rows[0] if rows else ''}"[:420], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR {n} {time.time() - t:.1f}s {str(e)[:900]}", flush=True)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    main(args, sf)
