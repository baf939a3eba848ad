"""Holding a query's rows against its SQL."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
    assert sorted(names) == columns
    assert mine == theirs
