"""Run the registered queries and their SQL twins side by side on one folder of tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(con, text: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(text)
    names = [column[0] for column in result.description]
    return sorted(names), rows_of(names, result.fetchall())
