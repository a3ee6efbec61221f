"""Run registered queries against their SQL twins: python tests/check_catalog.py [sf] [name-substring ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", round(x, 5) if isinstance(x, float) else x) if x is not None else (True, "", 0) for x in row)


def same(a, b, exact):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not exact:
        return abs(a - b) <= 2e-6 + 1e-9 * abs(a)
    return a == b


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    si, di = [spark_cols.index(c) for c in order], [duck_cols.index(c) for c in order]
    a = sorted((tuple(norm(r[i]) for i in si) for r in spark_rows), key=sort_key)
    b = sorted((tuple(norm(r[i]) for i in di) for r in duck_rows), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)} {a[:2]} {b[:2]}"
    inexact = 0
    for x, y in zip(a, b):
        if x != y:
            if not all(same(p, q, False) for p, q in zip(x, y)):
                return f"value {x} vs {y}"
            inexact += 1
    return f"close-only {inexact}/{len(a)}" if inexact else ""


def main():
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    picks = sys.argv[2:]
    import __spark_entry__ as e
    from tessella.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    qs, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if picks and not any(p in name for p in picks):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if name in oracle:
                t1 = time.time()
                cur = con.execute(oracle[name])
                cols = [d[0] for d in cur.description]
                msg = compare(rows, df.columns, cur.fetchall(), cols)
                took_d = time.time() - t1
                tag = "ok  " if not msg else ("near" if msg.startswith("close") else "FAIL")
            else:
                msg, tag, took_d = (f"rows-only {rows[0] if rows else ''}"[:150]), "rows" if rows else "EMPT", 0
            bad += tag in ("FAIL", "EMPT")
            print(f"{tag} {name} n={len(rows)} {took:.1f}s/{took_d:.1f}s {msg[:400]}", flush=True)
        except Exception as ex:
            bad += 1
            print(f"ERR  {name} {time.time() - t0:.1f}s {type(ex).__name__}: {str(ex)[:700]}", flush=True)
            if picks:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
