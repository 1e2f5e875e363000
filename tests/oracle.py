"""Compares a query with its SQL on DuckDB: same columns, same rows."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, bool):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(df, con, sql):
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns), (names, sorted(rel.columns))
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs, (names, len(ours), len(theirs), list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
