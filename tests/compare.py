"""A query against its SQL on the small tables, the way the driver compares them."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def same(spark, query, sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = query(spark, sf)
    names = sorted(got.columns)
    left = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    right = sorted(repr(tuple(plain(dict(zip(cols, row))[c]) for c in names)) for row in r.fetchall())
    assert sorted(cols) == names
    assert left == right
