"""Compares a query with its DuckDB SQL, whatever the order of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def same(df, sql, sf_dir):
    con = connection(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    ours = [tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()]
    order = [names.index(c) for c in sorted(names)]
    theirs = [tuple(norm(r[i]) for i in order) for r in theirs]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        assert a == b, (a, b)
    return len(ours)
