"""Compares a query with its SQL on DuckDB, as sets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in values)


def same(df, sql, sf_dir, con=None):
    con = con or connection(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert sum(got.values()) == sum(want.values()), (sum(got.values()), sum(want.values()))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
