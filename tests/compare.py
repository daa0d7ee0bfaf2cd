"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bytes, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, sql, sf_dir, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want, f"{list((got - want).items())[:3]} against {list((want - got).items())[:3]}"
