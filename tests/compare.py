"""Comparison of a Spark result with a DuckDB result, rows in any order."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark_df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(spark_df.columns) == sorted(names)
    expected, got = rows_of(names, found.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b
