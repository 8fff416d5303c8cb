"""Compares each query with its SQL twin in DuckDB: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if x is None or type(x).__name__ == "NAType":
        return None
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bool, np.bool_)):
        return int(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else int(x) if x == int(x) and abs(x) < 2**53 else round(x, 6)
    if type(x).__name__ in ("NaTType",):
        return None
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def connection(folder: str):
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return c


def difference(spark, con, name: str, f, sql: str, folder: str) -> str:
    a = f(spark, folder).toPandas()
    b = con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if x == y:
        return ""
    odd = next(((p, q) for p, q in zip(x, y, strict=False) if p != q), None)
    return f"{len(x)} and {len(y)} rows; first different {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connection(folder), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if (args and name not in args) or (not args and (name.startswith("op") and name[2].isdigit() or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = difference(spark, con, name, f, sql[name], folder) if name in sql else f"(no SQL) {f(spark, folder).count()} rows"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:400]}"
        if said:
            bad += 1
            print(f"{name}: {said} [{time.time() - began:.1f} s]", flush=True)
    print("not equal:", bad)
