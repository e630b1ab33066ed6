"""Run registered queries and compare them with their SQL: python tests/oracle.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v) if not isinstance(v, int) or isinstance(v, bool) else repr(float(v)) if abs(v) < 1 << 53 else repr(v)


def as_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, rows, seconds)"""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, "rows only", len(got), took
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    a, b = as_rows(df.columns, got), as_rows(want_cols, res.fetchall())
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}", len(got), took
    if a[1] != b[1]:
        in_a, in_b = set(a[1]), set(b[1])
        only_a, only_b = sorted(in_a - in_b)[:3], sorted(in_b - in_a)[:3]
        return False, f"rows {len(a[1])} vs {len(b[1])}; spark only {only_a}; sql only {only_b}", len(got), took
    return True, "ok", len(got), took


def main() -> None:
    from faultline.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, rows, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:
            ok, note, rows, took = False, f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} rows={rows} {took:.1f}s {note if note != 'ok' else ''}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
