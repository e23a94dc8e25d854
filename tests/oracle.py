"""Compares registered queries with their SQL in DuckDB."""

import glob
import os
from collections import Counter
from decimal import Decimal


def value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    return tuple(value(x) for x in v) if isinstance(v, (list, tuple)) else v


def views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    rel = views(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(value(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
