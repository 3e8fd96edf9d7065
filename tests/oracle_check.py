"""Run every registered query in Spark and its SQL twin in DuckDB; compare exactly.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column names, exact content (order-insensitive).
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def normalise(pdf):
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]")
    rows = [tuple(None if (isinstance(v, float) and v != v) or v is pd.NaT or v is None else v for v in r) for r in pdf.itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name:32s} spark_rows={len(spdf):6d} (no oracle) {t1 - t0:.2f}s"
    dpdf = con.execute(sql).df()
    same_cols = sorted(spdf.columns) == sorted(dpdf.columns)
    a, b = normalise(spdf), normalise(dpdf) if same_cols else []
    ok = same_cols and a == b
    if same_cols:
        dt = {c: (str(spdf[c].dtype), str(dpdf[c].dtype)) for c in spdf.columns if str(spdf[c].dtype).split("[")[0] != str(dpdf[c].dtype).split("[")[0]}
        if dt:
            ok = False
            msg_types = f" dtypes={dt}"
        else:
            msg_types = ""
    msg = f"{name:32s} {'OK  ' if ok else 'FAIL'} spark={len(spdf)} duck={len(dpdf)} {t1 - t0:.2f}s"
    if same_cols and msg_types:
        msg += msg_types
    if not same_cols:
        msg += f" cols spark={list(spdf.columns)} duck={list(dpdf.columns)}"
    elif not ok:
        sa, sb = set(a), set(b)
        msg += f" only_spark={list(sa - sb)[:2]} only_duck={list(sb - sa)[:2]}"
    return msg


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from fleetstops.session import build_session

    spark = build_session("local[8]", 8)
    if os.environ.get("CHECK_TZ"):  # run the Spark side under another session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            line = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            line = f"{name:32s} ERROR {type(e).__name__}: {str(e)[:300]}"
        fails += ("FAIL" in line) or ("ERROR" in line)
        print(line, flush=True)
    print(f"failures: {fails}")


if __name__ == "__main__":
    main()
