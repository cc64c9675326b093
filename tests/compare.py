"""Compares a registered query with its SQL twin in DuckDB, as the driver does.

``python -m tests.compare [sf_dir] [names...]``
"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.9g}"))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_result(df):
    return normalised(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, text):
    cur = con.execute(text)
    return normalised([d[0] for d in cur.description], cur.fetchall()), [str(d[1]) for d in cur.description]


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return None


def main() -> int:
    from pulsegrid.plans.registry import registered
    from pulsegrid.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    settings = {}
    while args and "=" in args[0]:
        key, value = args.pop(0).split("=", 1)
        settings[key] = value
    spark = local_session(**settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in registered().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            df = q.run(spark, sf_dir)
            got = spark_result(df)
            took = time.time() - started
            if q.sql:
                want, types = sql_result(con, q.sql)
                problem = difference(got, want)
            else:
                problem, want = None, None
            note = "ok" if problem is None else "DIFF " + problem
            print(f"{name:28s} {took:6.2f}s sql {time.time() - started - took:5.2f}s rows {len(got[1]):6d} {'' if q.sql else '(no sql) '}{note}", flush=True)
            failed += problem is not None
        except Exception as e:
            failed += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
