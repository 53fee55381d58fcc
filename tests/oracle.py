"""A query's rows against those of its SQL in DuckDB over the smallest tables."""

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return round(float(value), 5) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else value


def same(spark, query, sql, folder=FOLDER):
    found = query(spark, folder)
    names = sorted(found.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in found.collect())
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert got == sorted(str([plain(dict(zip(columns, r, strict=True))[c]) for c in names]) for r in result.fetchall())
    assert got
