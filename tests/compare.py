"""Compares a query with its SQL in DuckDB, without regard to the order of rows."""

import datetime
import glob
import math

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, bool) else int(v) if isinstance(v, int) else str(v)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET memory_limit = '2GB'; SET max_temp_directory_size = '1GB'; SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want
