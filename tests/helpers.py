"""Order-insensitive comparison of a Spark result with DuckDB's."""

from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (Decimal, float)) and not isinstance(x, bool):
        return None if x != x else float(x)
    if isinstance(x, date) and not isinstance(x, datetime):
        return datetime(x.year, x.month, x.day)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(plain(v[i]) for i in order) for v in values], key=repr)


def same(df, con, sql) -> None:
    result = con.sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(result.columns, result.fetchall())
