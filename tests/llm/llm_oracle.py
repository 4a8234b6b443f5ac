"""Compares a query with its DuckDB SQL over a folder of tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def same(spark, query, sql, sf_dir="/root/testdata/sf0.001", tables=TABLES):
    con = duckdb.connect()
    for name in tables:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(sql)
    names = sorted(want.columns)
    got = query(spark, sf_dir)
    assert sorted(got.columns) == names
    want = sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*names).collect()), key=repr) == want
    return len(want)
