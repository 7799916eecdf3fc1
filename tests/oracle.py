"""Running a query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{source}')")
    return con


def plain(v):
    """A value without what the two engines render differently."""
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def same(spark, con, query, sql: str, sf: str = SF) -> int:
    """Assert equal rows; returns their number."""
    df = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)
    assert got == want
    return len(got)
