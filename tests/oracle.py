"""Comparing a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(str, map(plain, value))) + "]"
    return repr(value)


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def agree(df, con, sql):
    done = con.execute(sql)
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(done.fetchall(), columns)
