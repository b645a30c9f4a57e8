"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
from pyspark.sql import DataFrame


def value(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def from_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)


def from_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            con.sql(f"CREATE VIEW {file[:-8]} AS FROM '{sf_dir}/{file}'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
