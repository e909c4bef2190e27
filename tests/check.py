"""Compare registered queries with their DuckDB statements.

Run as a script: ``python tests/check.py [scale] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    try:
        f = float(v)
        return f if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    """Empty text if equal, else the first differences."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    order_s = [spark_cols.index(c) for c in sorted(spark_cols)]
    order_d = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = Counter(tuple(_cell(r[i]) for i in order_s) for r in spark_rows)
    b = Counter(tuple(_cell(r[i]) for i in order_d) for r in duck_rows)
    if a == b:
        return ""
    return (
        f"rows {sum(a.values())} vs {sum(b.values())}; cols {sorted(spark_cols)}; "
        f"spark only {sorted((a - b), key=str)[:3]} duck only {sorted((b - a), key=str)[:3]}"
    )


def check(spark, con, sf_dir, name, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return ("" if rows else "no rows"), len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return compare(rows, df.columns, cur.fetchall(), names), len(rows), took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from trialloom.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"{DATA}/sf{scale}")
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, took = check(spark, con, f"{DATA}/sf{scale}", name, query, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0.0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={n:<7d} {took:6.2f}s "
              f"{'oracle' if name in oracle else 'rows-only'} {problem}", flush=True)
    print("failed:", bad)
