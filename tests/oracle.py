"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from ledgermatch.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' when rows and column names agree, else a description."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"
    if actual == expected:
        return ""
    extra, lost = actual - expected, expected - actual
    return (
        f"rows: spark {sum(actual.values())} sql {sum(expected.values())}; "
        f"only spark {sum(extra.values())} {list(extra)[:3]}; only sql {sum(lost.values())} {list(lost)[:3]}"
    )
