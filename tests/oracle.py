"""Runs a registered query in Spark and its oracle in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "asDict"):
        return canon(tuple(value.asDict().values()))
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    packed = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(packed, key=repr)


def run_pair(spark, sf_dir, query, sql, con=None):
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    if sql is None:
        return False, f"rows={len(got[1])}, no oracle", spark_s
    cur = (con or duck(sf_dir)).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return True, f"rows={len(got[1])}", spark_s
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", spark_s
    from collections import Counter

    a, b = Counter(map(repr, got[1])), Counter(map(repr, want[1]))
    only_a, only_b = list((a - b).keys()), list((b - a).keys())
    return (
        False,
        f"rows {len(got[1])} vs {len(want[1])}; {got[0]}\n  spark only {len(only_a)}: {only_a[:3]}\n  duck only {len(only_b)}: {only_b[:3]}",
        spark_s,
    )


if __name__ == "__main__":
    from importlib import import_module

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from scholarmatch.session import local_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    from scholarmatch.plans import all_oracles

    module = import_module(f"scholarmatch.plans.{sys.argv[1]}")
    names = sys.argv[2:] or list(module.QUERIES)
    oracles = all_oracles()
    bad = 0
    for name in names:
        try:
            ok, note, secs = run_pair(spark, sf_dir, module.QUERIES[name], oracles.get(name), con)
        except Exception as exc:  # noqa: BLE001
            ok, note, secs = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {secs:6.2f}s {note}", flush=True)
    print("bad:", bad)
