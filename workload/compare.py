"""Compare a registered query with its SQL: rows, column names and values, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

from workload.views import BASE_TABLES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if both agree, else what differs."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} vs {sorted(names)}"]
    want = _rows(names, expected.fetchall())
    got = _rows(result.columns, result.collect())
    if len(got) != len(want):
        extra = [g for g in got if g not in want][:2]
        lacking = [w for w in want if w not in got][:2]
        return [f"{len(got)} rows vs {len(want)}; only here {extra}; only there {lacking}"]
    return [f"{g} vs {w}" for g, w in zip(got, want) if g != w or repr(g) != repr(w)][:3]
