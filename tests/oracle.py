"""Compare bound queries with their oracle statements.

    python -m tests.oracle [--sf 0.01] [key or prefix* ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import fnmatch
import sys
import time

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return ("nan",) if v != v else repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    s_names, s_rows = rows_of(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    res = con.execute(sql)
    d_names, d_rows = rows_of([c[0] for c in res.description], res.fetchall())
    if s_names != d_names:
        return f"columns {s_names} vs {d_names}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} vs {len(d_rows)}; {s_rows[:2]} vs {d_rows[:2]}"
    for a, b in zip(s_rows, d_rows):
        if repr(a) != repr(b):
            n = sum(repr(x) != repr(y) for x, y in zip(s_rows, d_rows))
            return f"{n}/{len(s_rows)} rows differ {s_names}\n   spark {a}\n   duck  {b}"
    if not s_rows:
        return "EMPTY"
    return None


def main(argv: list[str]) -> int:
    from driftline.plans import ORACLE_SQL, QUERIES
    from driftline.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    pats = argv or ["*"]
    keys = [k for k in QUERIES if any(fnmatch.fnmatch(k, p) for p in pats)]
    spark, con, bad = local_session(8), connection(sf_dir), []
    for k in keys:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, sf_dir)
            if k in ORACLE_SQL:
                msg = compare(df, con, ORACLE_SQL[k])
            else:
                n = len(df.collect())
                msg = None if n else "EMPTY (rows only)"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        tag = "ok" if msg is None else "BAD"
        if msg:
            bad.append(k)
        kind = "" if k in ORACLE_SQL else " (rows only)"
        print(f"{tag:4} {k} {time.time() - t0:.1f}s{kind} {msg or ''}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; bad: {bad}")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
