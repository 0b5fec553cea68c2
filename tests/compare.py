"""Runs queries beside their SQL and compares the rows: python tests/compare.py SF NAME..."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return str(v) if v is not None else None


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def compare(spark, name, sf_dir, query, sql):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r.asDict(True).values()) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    odd = [f"{c} {t}" for c, t in zip(rel.columns, map(str, rel.types)) if t.startswith(("HUGEINT", "UHUGEINT", "DECIMAL"))]
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if odd:
        return f"types of SQL that the query doesn't have: {odd}"
    if got != want:
        here, there = set(got), set(want)
        a, b = [x for x in got if x not in there][:3], [x for x in want if x not in here][:3]
        return f"{len(got)} and {len(want)} rows; only here {a}; only in SQL {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or qs:
        began = time.time()
        try:
            if name in sqls:
                said = compare(spark, name, f"/root/testdata/{sys.argv[1]}", qs[name], sqls[name]) or "same"
            else:
                said = f"no SQL, {qs[name](spark, f'/root/testdata/{sys.argv[1]}').count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:900]}"
        print(f"{name}: {said[:1500]} ({time.time() - began:.1f} s)", flush=True)
