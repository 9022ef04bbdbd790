"""Run registered queries beside their SQL and report differences.

    python tests/check.py [sf] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlens.session import builder  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "∅"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(mine), None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a == b:
        return len(mine), None
    extra = [r for r in a if r not in set(b)][:2]
    lost = [r for r in b if r not in set(a)][:2]
    return len(mine), f"{len(a)} vs {len(b)} rows; only spark {str(extra)[:400]}; only sql {str(lost)[:400]}"


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = builder("check").master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = database(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            n, problem = compare(spark, con, queries[name], oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            n, problem = -1, "".join(traceback.format_exception_only(e))[:700]
        took = time.time() - start
        bad += problem is not None
        mark = "FAIL" if problem else ("rows" if name not in oracle else "ok")
        print(f"{mark:4} {name:24} {n:8} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names or queries)} queries, {bad} bad")


if __name__ == "__main__":
    main()
