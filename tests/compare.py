"""Runs registered queries against their SQL checks in DuckDB on the same files."""

from __future__ import annotations

import math
import sys
import time
import pathlib

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, root, name, fn, sql):
    t = time.time()
    df = fn(spark, root)
    got = df.collect()
    took = time.time() - t
    names, mine = _rows(df.columns, got)
    if sql is None:
        return True, len(mine), took, "no sql"
    cur = con.execute(sql)
    want_names, theirs = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return False, len(mine), took, f"columns {names} != {want_names}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return False, len(mine), took, f"{len(mine)} vs {len(theirs)} rows; only spark: {sorted(a - b)[:3]}; only sql: {sorted(b - a)[:3]}"
    return True, len(mine), took, "ok"


if __name__ == "__main__":
    from lotlens.session import local_session
    import __spark_entry__ as entry

    root = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session("8")
    con = connect(root)
    checks = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            ok, n, took, note = compare(spark, con, root, name, fn, checks.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, n, took, note = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:<7d} {took:6.2f}s {'' if note == 'ok' else note}", flush=True)
    print("failed:", bad)
