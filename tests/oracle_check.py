"""Run registered queries next to their SQL in DuckDB: ``python tests/oracle_check.py [sf_dir] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool):
        return v
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name: str, sf_dir: str, fn, sql: str | None):
    """(ok, message, seconds of the Spark side)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(got), f"rows {len(got)} (no SQL)", took
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    a_cols, a = rows_of(df.columns, got)
    b_cols, b = rows_of(want_cols, want)
    if a_cols != b_cols:
        return False, f"columns {a_cols} vs {b_cols}", took
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if t in kinds and kinds[t] != types[c]]
    note = f" TYPES {bad}" if bad else ""
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}{note}\n   {a[:2]}\n   {b[:2]}", took
    from collections import Counter

    extra, missing = Counter(a) - Counter(b), Counter(b) - Counter(a)
    if extra:
        show = lambda c: sorted(c, key=repr)[:2]
        return False, f"{sum(extra.values())} of {len(a)} rows differ{note}; cols {a_cols}\n   {show(extra)}\n   {show(missing)}", took
    return not bad, f"rows {len(a)}{note}", took


def main() -> int:
    from starfold.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    sqls, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, message, took = check(spark, con, name, sf_dir, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message, took = False, "".join(traceback.format_exception_only(type(e), e))[:900], 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.1f}s {name}: {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"failed {len(failed)}: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
