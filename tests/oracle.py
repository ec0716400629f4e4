"""Comparing a query with its SQL."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings runs record_edges observations aliases texts text_embeddings mix_targets".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') or [path]!r})")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def assert_same(df, con, sql):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(relation.columns, relation.fetchall())
