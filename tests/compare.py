"""Row-by-row comparison of a query with its SQL, order ignored."""

from __future__ import annotations

import math

import duckdb

from meritlake.plans.driver_views import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6)
    return value


def difference(frame, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    columns = sorted(frame.columns)
    spark_rows = sorted(
        (tuple(_plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    cursor = connection.execute(sql)
    names = [item[0] for item in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    places = [names.index(c) for c in columns]
    sql_rows = sorted(
        (tuple(_plain(row[i]) for i in places) for row in cursor.fetchall()), key=repr)
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    for left, right in zip(spark_rows, sql_rows):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            pairs = [(c, a, b) for c, a, b in zip(columns, left, right) if a != b or type(a) is not type(b)]
            return f"first difference {str(pairs)[:900]}"
    return None
