"""Run registered queries against their DuckDB oracles: ``check_oracle.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return {k: norm(x) for k, x in sorted(v.asDict().items())}
    return v if isinstance(v, str) else float(v) if hasattr(v, "__float__") else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, fn, text):
    df = fn(spark, sf)
    sc, sr = rows_of(df.columns, df.collect())
    if text is None:
        return None, f"{len(sr)} rows, no oracle"
    cur = con.execute(text)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return False, f"columns {sc} vs {dc}"
    from collections import Counter
    a, b = Counter(map(repr, sr)), Counter(map(repr, dr))
    if a != b:
        lost, extra = sorted((b - a).elements()), sorted((a - b).elements())
        return False, f"rows {len(sr)} vs {len(dr)}, {len(extra)} differ; spark {extra[:2]}; sql {lost[:2]} {sc}"
    return True, f"{len(sr)} rows"


def main(argv):
    from tidemark.plans import load
    from tidemark.session import local_session
    args = argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark, con = local_session(8), connect(sf)
    failed = []
    for n in names:
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, sf, queries[n], oracles.get(n))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        print(f"{mark} {n:40s} {time.time() - t0:6.2f}s {msg}", flush=True)
        if ok is False:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
