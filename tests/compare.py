"""Rows of a Spark query against those of its SQL."""

import os


def connect(folder):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" if os.path.isfile(f"{folder}/{name}") else f"{folder}/{name}/*.parquet"
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return db


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def same(df, db, sql):
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = plain([tuple(r) for r in df.collect()], df.columns), plain(found.fetchall(), found.columns)
    assert ours == theirs
    return len(ours)
