"""Compare a query with its SQL in DuckDB on the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v).removesuffix("+00:00")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in values), key=str)


def same(df, con, sql):
    got = df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())
    return len(got)
