"""Rows of a query and of its SQL, in one form."""

import math
from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return repr(round(float(x), 9))


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


def of_query(df):
    return rows(df.columns, df.collect())


def of_sql(con, sql):
    got = con.execute(f"select * from ({sql})")
    return rows([c[0] for c in got.description], got.fetchall())
