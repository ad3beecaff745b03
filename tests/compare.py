"""Run operators and their SQL on the same files and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall(), [str(d[1]) for d in cursor.description]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark_frame, con, sql: str):
    """None where both sides agree in columns, number of rows and values; else a text."""
    names = spark_frame.columns
    ours = rows_of(names, [tuple(r) for r in spark_frame.collect()])
    sql_names, rows, kinds = sql_rows(con, sql)
    if sorted(names) != sorted(sql_names):
        return f"columns differ: {sorted(set(names) ^ set(sql_names))}", len(ours)
    theirs = rows_of(sql_names, rows)
    # INTEGER stands for an int, and for nothing else.
    short = {f.name for f in spark_frame.schema if f.dataType.simpleString() == "int"}
    odd = [(n, k) for n, k in zip(sql_names, kinds) if any(x in k for x in ("HUGEINT", "DECIMAL", "DATE", "TIME")) or (k == "INTEGER") != (n in short)]
    if odd:
        return f"types: {odd}", len(ours)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, SQL has {len(theirs)}", len(ours)
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            bad = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if repr(x) != repr(y)]
            return f"values: {bad} in {a}", len(ours)
    return None, len(ours)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from marquee.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if "--no-broadcast" in wanted:  # the way of large tables: every join is a shuffle
        wanted.remove("--no-broadcast")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    con, q, o = database(sf), queries(), oracle_sql()
    bad = 0
    for name in q:
        if wanted and not any(name.startswith(x) for x in wanted):
            continue
        began = time.time()
        try:
            if name in o:
                problem, n = difference(q[name](spark, sf), con, o[name])
            else:
                problem, n = "no SQL", q[name](spark, sf).count()
        except Exception as error:  # a report goes on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32} {n:7} rows {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print("missing SQL:", sorted(set(q) - set(o)), "SQL without query:", sorted(set(o) - set(q)))
    print("bad:", bad)
