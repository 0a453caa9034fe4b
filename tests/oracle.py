"""Runs a registered query and its reference SQL on the same tables and compares the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FOLDER = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_TYPES = {"timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def compare(spark, con, folder, run, sql):
    df = run(spark, folder)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    types = {d[0]: str(d[1]) for d in answer.description}
    want_columns, want = rows_of([d[0] for d in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} / {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {[x for x in got if x not in set(want)][:2]} / {[x for x in want if x not in set(got)][:2]}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(a - b)} rows differ: {sorted(a - b)[:2]} / {sorted(b - a)[:2]}"
    odd = {n: (t, types[n]) for n, t in df.dtypes if _TYPES.get(t, t) != types[n]}
    return f"types {odd}" if odd else None


def main(folder=FOLDER, *names):
    import __spark_entry__ as entry
    from evidence_lake.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, queries[name], sql[name])
            else:
                problem = f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__} {str(error)[:1500]}"
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
