"""Compares a query with its SQL on DuckDB."""

import math
from pathlib import Path

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=FOLDER):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def available() -> bool:
    return Path(FOLDER).is_dir()


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    result = con.execute(sql)
    want = rows([d[0] for d in result.description], result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]
