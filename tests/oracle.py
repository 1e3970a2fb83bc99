"""Compare a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def compare(frame, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    columns = sorted(frame.columns)
    assert sorted(names) == columns
    want = sorted(tuple(same(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(same(r[c]) for c in columns) for r in frame.collect())
    assert got == want
