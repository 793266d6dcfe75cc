"""Runs registered queries against their SQL in DuckDB: python tests/compare.py SF [NAME...]."""

import os
import re
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(root):
    con = duckdb.connect()
    for f in sorted(os.listdir(root)):
        if f.endswith(".parquet"):
            p = f"{root}/{f}" + ("/*.parquet" if os.path.isdir(f"{root}/{f}") else "")
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{p}')")
    return con


def canon(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(canon(x)) for x in v) + "]"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    return str(v)


def rows(cols, data):
    o = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in o], sorted(tuple(str(canon(r[i])) for i in o) for r in data)


def compare(spark, root, name, query, sql):
    t = time.time()
    df = query(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got[1])} rows, {took:.1f} s, no SQL", True
    t = time.time()
    con = duck(root)
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    same = got == want
    text = f"{name}: {len(got[1])} rows, {took:.1f} s, SQL {time.time() - t:.1f} s, " + ("same" if same else "DIFFERENT")
    if not same:
        text += f"\n  columns {got[0]} / {want[0]}; SQL rows {len(want[1])}"
        g, w = set(got[1]), set(want[1])
        text += f"\n  only Spark {sorted(g - w)[:3]}\n  only SQL {sorted(w - g)[:3]}"
    return text, same


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('COMPARE_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as E

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, s = E.queries(), E.oracle_sql()
    names = [n for n in q if not sys.argv[2:] or any(re.fullmatch(x, n) for x in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            text, ok = compare(spark, f"/root/testdata/{sys.argv[1]}", n, q[n], s.get(n))
        except Exception as e:
            text, ok = f"{n}: {type(e).__name__} {str(e)[:1500]}", False
        bad += not ok
        print(text, flush=True)
    print("bad", bad)
    sys.exit(bool(bad))
