"""Compares a Spark result with DuckDB's answer to the checking SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    picked = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in picked) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    answer = con.execute(sql)
    expected_columns = [d[0] for d in answer.description]
    expected_types = {d[0]: str(d[1]) for d in answer.description}
    expected = _rows(expected_columns, answer.fetchall())
    got = _rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} against {sorted(expected_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for a, b in zip(got, expected, strict=True):
        if a != b:
            return f"{str(a)[:600]}\n  against\n{str(b)[:600]}\n{expected_types}"
    return None
