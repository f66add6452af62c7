"""Compare query results with those of their SQL counterparts."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def as_rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), as_rows(df.columns, df.collect())


def duck_rows(con, sql) -> tuple[list[str], list[tuple]]:
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    return sorted(columns), as_rows(columns, res.fetchall())
