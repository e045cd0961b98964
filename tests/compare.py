"""Run registered queries beside their SQL on DuckDB and compare the results.

Usage: python -m tests.compare [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return ("bool", v)
    if hasattr(v, "as_tuple"):
        return ("decimal", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(data, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_result(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return rows_of(columns, cur.fetchall())


def difference(spark_side, sql_side) -> str | None:
    """First difference between two results, None when equal."""
    (sc, sr), (dc, dr) = spark_side, sql_side
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"row counts {len(sr)} != {len(dr)}; first spark {sr[:1]} first sql {dr[:1]}"
    for a, b in zip(sr, dr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a}\n      sql   {b}  columns {sc}"
    return None


def main(argv: list[str]) -> int:
    from tidemark import build_session
    from tidemark.workload.registry import load_all

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, q in load_all().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        started = time.time()
        try:
            got = spark_result(q.build(spark, sf))
            took = time.time() - started
            problem = difference(got, sql_result(con, q.sql)) if q.sql else None
            status = "ok" if not problem else "DIFF"
        except Exception as error:
            took, got, status, problem = time.time() - started, ([], []), "FAIL", f"{type(error).__name__}: {str(error)[:400]}"
        bad += status != "ok"
        print(f"{status:5} {name:40} {len(got[1]):8} rows {took:6.2f}s {'' if q.sql else '(rows only)'}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
