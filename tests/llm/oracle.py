"""Compare a query with its SQL in DuckDB, as sets of rows with repeats."""

from collections import Counter

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(sql, folder, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(r[i] for i in order) for r in got.fetchall())


def frame_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*names).collect())
