"""Compares a query with its SQL, as multisets of rows with their columns sorted by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([repr(r[i]) for i in order] for r in values)


def same(spark, query, sql):
    df = query(spark, FOLDER)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    out = connect().execute(sql)
    names = [d[0] for d in out.description]
    assert not any("HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1]) for d in out.description)
    assert found == rows(names, out.fetchall())
