"""Run registered queries next to their SQL and compare whole results.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, fn, sql, sf):
    """An empty list when both sides agree, else what differs."""
    df = fn(spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = canonical(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    if not got:
        return ["no rows"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}", *odd_ones(got, want)]
    kinds = {tuple(type(v).__name__ for v in r) for r in got[:50]} ^ {tuple(type(v).__name__ for v in r) for r in want[:50]}
    if got == want and kinds:
        return [f"types differ: {kinds}"]
    return [] if got == want else odd_ones(got, want)


def odd_ones(got, want):
    a, b = set(map(repr, got)), set(map(repr, want))
    return [f"only ours: {sorted(a - b)[:3]}", f"only SQL: {sorted(b - a)[:3]}"]


def main():
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    from __spark_entry__ import oracle_sql, queries

    from freshet.session import session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf), oracle_sql()
    failed = []
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            diff = differences(spark, con, fn, oracles[name], sf) if name in oracles else [f"rows only: {fn(spark, sf).count()}"]
        except Exception as exc:
            diff = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        if diff:
            failed.append(name)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s", *diff, sep="\n     " if diff else " ", flush=True)
    print(f"{len(failed)} failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
