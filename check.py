"""Compare registered queries with their SQL in DuckDB.

    python check.py [sf folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from ringfold.plans.registry import REGISTRY
from ringfold.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"create view {name} as select * from '{folder}/{name}.parquet'"
        )
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value + 0.0, 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    run, sql = REGISTRY[name]
    start = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = rows_of(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    ok = len(got) == len(want) and not wrong and bool(got)
    note = f"{len(got)}/{len(want)} rows, {len(wrong)} differ, {spent:.1f}s, sql {time.time() - start:.1f}s"
    if not ok:
        note += f" e.g. {sorted(df.columns)} {wrong[:2]}"
    return ok, note


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or list(REGISTRY)
    spark = build_session("check", "local[8]", 8, **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} match", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
