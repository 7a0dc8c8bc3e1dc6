"""Compare registered queries with their DuckDB SQL."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(spark, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    want_names, want = rows([c[0] for c in cur.description], cur.fetchall())
    assert names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
    assert got
