"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else a description."""
    spark_columns, got = spark_rows(df)
    sql_columns, expected = sql_rows(con, sql)
    if spark_columns != sql_columns:
        return f"columns {spark_columns} and {sql_columns}"
    if got == expected:
        return None
    extra, missing = got - expected, expected - got
    return (f"{sum(got.values())} and {sum(expected.values())} rows; "
            f"only in Spark {list(extra)[:2]}; only in SQL {list(missing)[:2]}")
