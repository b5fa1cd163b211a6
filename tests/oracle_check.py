"""Run registered queries next to their SQL and compare rows, columns and types.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "float", v) for v in row)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else the first difference."""
    columns, rows = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    o_columns, o_rows = _table([d[0] for d in cur.description], cur.fetchall())
    if columns != o_columns:
        return f"columns {columns} != {o_columns}"
    if len(rows) != len(o_rows):
        return f"rows {len(rows)} != {len(o_rows)}; {rows[:2]} / {o_rows[:2]}"
    for a, b in zip(rows, o_rows):
        if not all(_same(x, y) for x, y in zip(a, b)):
            n = sum(1 for p, q in zip(rows, o_rows) if not all(_same(x, y) for x, y in zip(p, q)))
            return f"{n} of {len(rows)} rows differ: {str(a)[:300]} != {str(b)[:300]} {columns}"
    return "" if rows else "empty"


def main() -> None:
    import __spark_entry__ as e
    from reckoner import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                df = fn(spark, folder)
                diff = compare(df, con, oracles[name])
            else:
                n = fn(spark, folder).count()
                diff = "" if n else "empty"
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if not diff else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {diff}", flush=True)
        if diff:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")


if __name__ == "__main__":
    main()
