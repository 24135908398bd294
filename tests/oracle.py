"""Row-by-row comparison of a DataFrame with DuckDB SQL over the same tables."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return float(f"{v:.12g}") if isinstance(v, float) else v


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def assert_same(df, sql, con):
    cols = sorted(df.columns)
    mine = [tuple(clean(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = [tuple(clean(r[i]) for i in at) for r in cur.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(mine, key=key) == sorted(theirs, key=key)
