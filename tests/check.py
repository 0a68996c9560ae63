"""Run the registered queries next to their SQL and report any difference.

    python tests/check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.copysign(1.0, value) < 0 and value == 0.0:
        return "-0.0"
    return value


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str | None) -> tuple[str, int]:
    df = query(spark, sf_dir)
    table = df.toArrow()
    got = sorted_rows(df.columns, list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else [])
    if sql is None:
        return "no sql", len(got)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(got)
    kinds = dict(zip(names, (str(c[1]) for c in result.description)))
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (mine[n], kinds[n]) for n in names if same.get(mine[n]) != kinds[n]}
    want = sorted_rows(names, result.fetchall())
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"rows {len(got)} against {len(want)}, first {bad}", len(got)
    return (f"types {odd}" if odd else "ok"), len(got)


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from patchlight.session import spark_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(queries())
    spark = spark_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    good = 0
    for name in names:
        started = time.time()
        try:
            verdict, count = difference(spark, con, sf_dir, queries()[name], oracle_sql().get(name))
        except Exception as error:
            verdict, count = f"{type(error).__name__}: {str(error)[:600]}", 0
        good += verdict == "ok"
        print(f"{name:40s} {count:8d} rows {time.time() - started:6.2f}s  {verdict}", flush=True)
    print(f"{good} of {len(names)} equal", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
