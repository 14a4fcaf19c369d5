"""Order-insensitive comparison of a query with its DuckDB SQL."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

FOLDER = "/root/testdata/sf0.001"


def normal(value: object) -> object:
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def check(df: DataFrame, sql: str, folder: str = FOLDER) -> int:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    own = Counter(tuple(map(normal, r)) for r in df.select(*columns).collect())
    other = Counter(tuple(map(normal, r)) for r in want.select(*map(duckdb.ColumnExpression, columns)).fetchall())
    assert own == other
    return own.total()
