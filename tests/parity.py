"""Compare registered queries with their SQL form: python tests/parity.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(normal(x) for x in v.values())
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(df):
    cols = sorted(df.columns)
    out = [tuple(normal(v) for v in r) for r in df.select(*[df[f"`{c}`"] for c in cols]).collect()]
    return cols, sorted(out, key=lambda r: tuple(map(str, r)))


def compare(spark, con, sf_dir, fn, sql):
    t = time.time()
    cols, got = rows_of(fn(spark, sf_dir))
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", took
    t = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=lambda r: tuple(map(str, r)))
    took_sql = time.time() - t
    if sorted(names) != cols:
        return f"MISMATCH columns {cols} vs {sorted(names)}", took
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} vs {len(want)}", took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        types = [(type(a), type(b)) for a, b in zip(*bad[0])]
        return f"MISMATCH values {len(bad)}/{len(got)} {cols} e.g. {bad[0]} {types if any(x != y for x, y in types) else ''}", took
    return f"ok {len(got)} (sql {took_sql:.1f}s)", took


def main():
    import __spark_entry__ as E
    from conceptframe.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, oracles, fails = duck(sf_dir), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict, took = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, took = "ERROR " + str(e)[:600].replace("\n", " "), 0
        fails += verdict.startswith(("MIS", "ERR"))
        print(f"{took:6.1f}s {name}: {verdict[:900]}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
