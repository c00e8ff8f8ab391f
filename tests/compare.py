"""Compare registered queries with their SQL in DuckDB.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else repr(value)
    return str(value) if value is not None else None


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def difference(df, con, sql) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    got_names, got = rows_by_name(df.columns, df.collect())
    answer = con.execute(sql)
    want_names, want = rows_by_name([d[0] for d in answer.description], answer.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        return (
            f"rows {sum(got.values())} vs {sum(want.values())};"
            f" extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
        )
    if not got:
        return "both sides are empty"
    return None


def spark_kinds(df):
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}
    return {n: names.get(t, t) for n, t in df.dtypes}


def type_difference(df, con, sql) -> str | None:
    described = con.execute(f"DESCRIBE ({sql})").fetchall()
    want = {row[0]: row[1] for row in described}
    got = spark_kinds(df)
    wrong = {n: (got[n], want.get(n)) for n in got if got[n] != want.get(n)}
    return f"types {wrong}" if wrong else None


def main() -> None:
    from tapeloom.driver import ORACLES, QUERIES
    from tapeloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, con, ORACLES[name]) or type_difference(df, con, ORACLES[name])
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s"
              + (f" {problem}" if problem else ""), flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")


if __name__ == "__main__":
    main()
