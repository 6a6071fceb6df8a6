"""Compares a Spark query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if v is None or v != v:
        return None
    return repr(float(v) + 0.0) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


def same(spark_rows, columns, relation):
    assert sorted(columns) == sorted(relation.columns)
    order = sorted(columns)
    a = sorted((tuple(norm(r[c]) for c in order) for r in spark_rows), key=str)
    b = sorted((tuple(norm(x) for x in r) for r in relation.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b
