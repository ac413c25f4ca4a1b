"""Spark and DuckDB answers as comparable, order-free rows."""

from __future__ import annotations

import duckdb

from conformance.spark_queries import TABLES

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((value is not None, str(value)) for value in row))


def spark_rows(df):
    return _sorted([tuple(row) for row in df.collect()], df.columns)


def spark_types(df):
    return {name: TYPES.get(kind, kind) for name, kind in df.dtypes}


def duck_rows(connection, sql):
    relation = connection.sql(sql)
    return _sorted(relation.fetchall(), relation.columns), dict(zip(relation.columns, map(str, relation.types)))
