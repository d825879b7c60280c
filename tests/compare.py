"""Runs registered queries and their SQL side by side and compares the values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_time, start = time.time() - start, time.time()
    if sql is None:
        return True, f"{name}: rows={len(got[1])} spark={spark_time:.1f}s (no SQL)"
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    sql_time = time.time() - start
    note = f"rows={len(got[1])}/{len(want[1])} spark={spark_time:.1f}s sql={sql_time:.1f}s"
    if got[0] != want[0]:
        return False, f"{name}: columns {got[0]} != {want[0]} {note}"
    if got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return False, f"{name}: VALUES {note} {str(diff)[:1500]}"
    return True, f"{name}: ok {note}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{name}: ERROR {type(error).__name__} {str(error)[:1200]}"
        bad += not ok
        print(("    " if ok else "BAD ") + note, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
