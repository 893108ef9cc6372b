"""Run registered queries beside their SQL and compare rows: python tests/compare.py SF [name...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tallyfloor")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def compare(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    rows = [tuple(_cell(v) for v in row) for row in df.select(*sorted(df.columns)).collect()]
    if sql is None:
        return f"rows-only {len(rows)}", True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = [cols.index(c) for c in sorted(cols)]
    want = [tuple(_cell(row[i]) for i in order) for row in cur.fetchall()]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(set(cols) ^ set(df.columns))}", False
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = dict(df.dtypes)
    expect = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    off = [f"{c}:{kinds[c]}/{types[c]}" for c in cols if expect.get(kinds[c]) != types[c]]
    key = lambda t: tuple((v is None, str(type(v)), round(v, 6) if isinstance(v, float) else v) for v in t)
    try:
        rows.sort(key=key), want.sort(key=key)
    except TypeError as e:
        return f"types {e} {off}", False
    if len(rows) != len(want):
        return f"rows {len(rows)} vs {len(want)}", False
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    close = all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-7)
        for a, b in bad for x, y in zip(a, b)
    )
    if bad:
        return f"{'ulp' if close else 'VALUES'} {len(bad)}/{len(rows)} e.g. {bad[0][0]} vs {bad[0][1]} {off}", False
    return f"ok {len(rows)} {('TYPES ' + str(off)) if off else ''}", not off


def main():
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    want = sys.argv[2:]
    spark, con = session(), duck(sf)
    sqls, failed = entry.oracle_sql(), []
    for name, q in entry.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            msg, ok = compare(spark, con, name, q, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"ERROR {str(e)[:700]}", False
        if not ok:
            failed.append(name)
        print(f"{name:38s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
